"""Prefix trie of conversations by an external mergesort that knows common prefixes.

A conversation is a path of turns, 16 bytes of digest each. Arrow batches of conversations are sorted into runs, and each
row of a run carries the length of the prefix that it shares with the row before it. Regular samples of the runs cut the
order of all paths into parts of even weight; in a part, a loser tree merges the slices of the runs, and compares turns
only beyond the prefix that two candidates are known to share with the last row put out. The merged stream feeds a stack of
the open path: a node is finished, and put out, when a row leaves it. Only nodes on the paths of the cuts themselves can
have conversations in several parts; those are put out as partial sums, which one more pass adds up.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from hashlib import blake2b, sha256
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweir.llm.common import batches_of, dropped, stored

#: Bytes of a turn's digest, rows of a run, and turns (with one more a conversation) that a part is meant to have.
TOKEN = 16
RUN_ROWS = 10_000
PART_TURNS = 200_000
#: Parts at most, whose cuts are broadcast, and samples for each of them.
MOST_PARTS, OVERSAMPLING = 4096, 8
#: Conversations of one row of a list of ids.
IDS = 4096

RUN = "run bigint, ix int, conv_id bigint, path binary, chars array<int>, lcp int, weight bigint"
NODE = "kind int, key binary, parent binary, conv_id bigint, parent_conv_id bigint, depth bigint, chars bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, part int, seq int, ends string"
COMPLETE, OPEN, ENDS = 0, 1, 2


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Turns that two paths share, of which `known` are known to be shared."""
    at, most = known * TOKEN, min(len(a), len(b))
    while at < most and a[at : at + TOKEN] == b[at : at + TOKEN]:
        at += TOKEN
    return at // TOKEN


def node_key(path: bytes, depth: int) -> bytes:
    return blake2b(path[: depth * TOKEN], digest_size=16).digest()


class LoserTree:
    """Merges sorted slices of (path, conv_id, chars, lcp); put out with the turns shared with the row put out before."""

    def __init__(self, slices: list[Iterator[tuple]]) -> None:
        self.slices = slices
        self.size = 1 << max(0, len(slices) - 1).bit_length()
        self.head = [next(s, None) for s in slices] + [None] * (self.size - len(slices))
        self.lcp = [0] * self.size
        self.loser = [0] * self.size
        self.winner = self._play(1)

    def _beats(self, a: int, b: int) -> bool:
        """Whether the row of slice a comes first; the other one then knows what it shares with the first."""
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return y is None
        if self.lcp[a] != self.lcp[b]:
            return self.lcp[a] > self.lcp[b]
        shared = common(x[0], y[0], self.lcp[a])
        at = shared * TOKEN
        first = (x[0][at : at + TOKEN], x[1]) < (y[0][at : at + TOKEN], y[1])
        self.lcp[b if first else a] = shared
        return first

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._play(2 * node), self._play(2 * node + 1)
        if self._beats(a, b):
            self.loser[node] = b
            return a
        self.loser[node] = a
        return b

    def __iter__(self) -> Iterator[tuple[bytes, int, list[int], int]]:
        while (row := self.head[w := self.winner]) is not None:
            yield row[0], row[1], row[2], self.lcp[w]
            self.head[w] = next(self.slices[w], None)
            if self.head[w] is not None:
                self.lcp[w] = self.head[w][3]
            node = (w + self.size) >> 1
            while node:
                if self._beats(self.loser[node], w):
                    self.loser[node], w = w, self.loser[node]
                node >>= 1
            self.winner = w


class Node:
    """An open node: what its finished children, and the conversations that end at it, have added up to."""

    __slots__ = ("chars", "children", "convs", "digest", "ids", "key", "leaves", "least", "rows", "saved")

    def __init__(self, chars: int, key: bytes | None) -> None:
        self.chars, self.key = chars, key  # a key: the node may have conversations in other parts
        self.convs = self.children = self.leaves = self.saved = 0
        self.least: int | None = None
        self.digest = None
        self.ids: list[str] = []
        self.rows: list[tuple] = []

    def add(self, convs: int, least: int) -> None:
        self.convs += convs
        self.least = least if self.least is None else min(self.least, least)

    def ends(self, conv: int) -> None:
        self.add(1, conv)
        if self.key is None:
            if self.digest is None:
                self.digest = sha256(str(conv).encode())
            else:
                self.digest.update(b",%d" % conv)
        else:
            self.ids.append(str(conv))


NO_ENDS = sha256().hexdigest()


def nodes_of_part(part: int, merged: Iterator[tuple], lower: bytes | None, upper: bytes | None) -> Iterator[tuple]:
    """Rows (NODE) of one part's nodes, from its rows in order and the paths of the cuts around it."""
    stack = [Node(0, node_key(b"", 0))]
    chunk = 0

    def ids(node: Node, depth: int) -> tuple:
        nonlocal chunk
        row = (ENDS, node.key, None, None, None, depth, 0, 0, 0, 0, 0, part, chunk, ",".join(node.ids))
        chunk, node.ids = chunk + 1, []
        return row

    def finish(path: bytes) -> Iterator[tuple]:
        """Take the last node, of this path, off the stack."""
        node, depth = stack.pop(), len(stack)
        if node.key is not None:
            if node.ids:
                yield ids(node, depth)
            if stack:
                stack[-1].add(node.convs, node.least)
            yield (OPEN, node.key, node_key(path, depth - 1) if depth else None, node.least, None, depth, node.chars, node.convs, node.children, node.leaves, node.saved, part, 0, "")
            return
        above = stack[-1]
        node.saved += (node.convs - 1) * node.chars
        node.leaves = node.leaves or 1
        above.add(node.convs, node.least)
        above.children, above.leaves, above.saved = above.children + 1, above.leaves + node.leaves, above.saved + node.saved
        yield from (row[:4] + (node.least,) + row[5:] for row in node.rows)
        own = (COMPLETE, None, above.key, node.least, None, depth, node.chars, node.convs, node.children, node.leaves, node.saved, part, 0, node.digest.hexdigest() if node.digest else NO_ENDS)
        if above.key is not None:
            yield own
        else:
            above.rows.append(own)  # waits for its parent's least conversation

    last = b""
    for path, conv, chars, shared in merged:
        while len(stack) - 1 > shared:
            yield from finish(last)
        depth = len(path) // TOKEN
        if len(stack) - 1 < depth:
            open_to = max(common(path, cut) if cut is not None else 0 for cut in (lower, upper))
            for d in range(len(stack), depth + 1):
                stack.append(Node(chars[d - 1], node_key(path, d) if d <= open_to else None))
        stack[-1].ends(conv)
        if len(stack[-1].ids) >= IDS:
            yield ids(stack[-1], depth)
        last = path
    while stack:
        yield from finish(last)


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<token, chars>>: a row a conversation, in order of turn (null first), equal turns by digest.

    token is 128 bits of the SHA-256 of role and text, as hex; null role or text: empty. Rows without a conv_id belong to no
    conversation and are left out.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    token = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * TOKEN)
    turn = F.struct("turn", token.alias("token"), F.char_length(text).alias("chars"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select("conv_id", turn.alias("x"))
    each = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return each.select("conv_id", F.transform("x", lambda x: F.struct(x["token"].alias("token"), x["chars"].alias("chars"))).alias("turns"))


def rebuilt(seqs: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """seqs with the first h turns of conversation c replaced by those of conversation c - c % every, h = crc32(decimal c) % most.

    All turns of that conversation if it has fewer, none if it isn't there; c's own first h turns go in any case.
    """
    c = F.col("conv_id")
    h = F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(most)).cast("int")
    none = F.array().cast(seqs.schema["turns"].dataType)
    bases = seqs.filter(c % every == 0).select(c.alias("base"), F.slice("turns", F.lit(1), F.lit(most - 1)).alias("begin"))
    both = seqs.withColumn("base", c - c % every).withColumn("h", h).join(bases, "base", "left")
    begin, own = F.slice(F.coalesce("begin", none), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.size("turns"))
    return both.select("conv_id", F.concat(begin, own).alias("turns"))


def sorted_runs(seqs: DataFrame) -> DataFrame:
    """Rows (RUN): each Arrow batch as a run in order of (path, conv_id); weight is the run's turns and rows up to the row."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, b in enumerate(batches):
            conv, path, chars = (b.column(c).to_pylist() for c in ("conv_id", "path", "chars"))
            order = sorted(range(len(conv)), key=lambda i: (path[i], conv[i]))
            lcp, weight, total, last = [], [], 0, b""
            for i in order:
                lcp.append(common(last, path[i]))
                last = path[i]
                total += len(chars[i]) + 1
                weight.append(total)
            pick = lambda x: [x[i] for i in order]  # noqa: E731, B023
            run = (TaskContext.get().partitionId() << 32) + k
            yield pa.RecordBatch.from_arrays(
                [pa.array([run] * len(order), pa.int64()), pa.array(range(len(order)), pa.int32()), pa.array(pick(conv), pa.int64()), pa.array(pick(path), pa.binary()), pa.array(pick(chars), pa.list_(pa.int32())), pa.array(lcp, pa.int32()), pa.array(weight, pa.int64())],
                ["run", "ix", "conv_id", "path", "chars", "lcp", "weight"],
            )

    path = F.unhex(F.array_join(F.transform("turns", lambda x: x["token"]), "")).alias("path")
    return seqs.select("conv_id", path, F.transform("turns", lambda x: x["chars"]).alias("chars")).mapInArrow(sort, RUN)


def cuts_of(runs: DataFrame) -> list[tuple[bytes, int]]:
    """(path, conv_id) at which parts begin, all but the first: regular samples of the runs by weight, every so many of them in order."""
    total = runs.agg(F.sum(F.size("chars") + 1)).first()[0] or 0
    parts = min(MOST_PARTS, -(-total // PART_TURNS))
    if parts < 2:
        return []
    step = F.lit(max(1, total // (parts * OVERSAMPLING)))
    before = F.col("weight") - F.size("chars") - 1
    samples = runs.filter(F.floor(F.col("weight") / step) > F.floor(before / step)).select("path", "conv_id")
    have = sorted((bytes(r.path), r.conv_id) for r in samples.toLocalIterator())
    return sorted({have[len(have) * i // parts] for i in range(1, parts)})


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in NODE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)], [name for name, _ in fields])


def merged_nodes(runs: DataFrame, cuts: list[tuple[bytes, int]]) -> DataFrame:
    """Rows (NODE) of all parts: complete nodes, partial sums of open ones, and the ids that end at these."""
    shipped = runs.sparkSession.sparkContext.broadcast(cuts)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = [bisect_right(shipped.value, x) for x in zip(b.column("path").to_pylist(), b.column("conv_id").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part, pa.int32())], [*b.schema.names, "part"])

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in ("part", "run", "path", "conv_id", "chars", "lcp")), strict=True)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for part, rows in groupby(rows_of(batches), key=lambda r: r[0]):
            slices = [iter([r[2:] for r in run]) for _, run in groupby(rows, key=lambda r: r[1])]
            at = shipped.value
            lower, upper = at[part - 1][0] if part else None, at[part][0] if part < len(at) else None
            for row in nodes_of_part(part, LoserTree(slices), lower, upper):
                out.append(row)
                if len(out) == RUN_ROWS:
                    yield batch_of(out)
                    out = []
        if out:
            yield batch_of(out)

    dealt = runs.mapInArrow(assign, RUN + ", part int").repartition(len(cuts) + 1, "part").sortWithinPartitions("part", "run", "ix")
    return dealt.drop("weight").mapInArrow(merge, NODE)


def whole_sums(open_nodes: DataFrame) -> DataFrame:
    """open_nodes (key, parent, depth, chars, n_convs, n_children, n_leaves, saved_tokens) with the last two summed over
    open nodes below too. They lie on the paths of at most MOST_PARTS cuts, and one task passes over them, deepest first."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below: dict[bytes, list[int]] = {}
        for b in batches:
            leaves, saved = [], []
            columns = (b.column(c).to_pylist() for c in ("key", "parent", "chars", "n_convs", "n_children", "n_leaves", "saved_tokens"))
            for key, parent, chars, convs, children, own_leaves, own_saved in zip(*columns, strict=True):
                more = below.pop(key, [0, 0])
                leaves.append(own_leaves + more[0] + (not children))
                saved.append(own_saved + more[1] + (convs - 1) * chars)
                up = below.setdefault(parent, [0, 0])
                up[0] += leaves[-1]
                up[1] += saved[-1]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(leaves, pa.int64()), pa.array(saved, pa.int64())], ["key", "n_leaves", "saved_tokens"])

    columns = ["key", "parent", "depth", "chars", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    summed = open_nodes.select(*columns).repartition(1).sortWithinPartitions(F.desc("depth")).mapInArrow(fold, "key binary, n_leaves bigint, saved_tokens bigint")
    return open_nodes.drop("n_leaves", "saved_tokens").join(summed, "key")


def digests(chunks: DataFrame) -> DataFrame:
    """key, ends_sha256 of rows (key, part, seq, ends): the digest runs over a node's lists of ids in order and holds none of them."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(b.column("key").to_pylist(), b.column("ends").to_pylist(), strict=True))
        for key, lists in groupby(rows, key=lambda r: r[0]):
            h = sha256(next(lists)[1].encode())
            for _, more in lists:
                h.update(b"," + more.encode())
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([h.hexdigest()])], ["key", "ends_sha256"])

    return chunks.select("key", "part", "seq", "ends").repartition("key").sortWithinPartitions("key", "part", "seq").mapInArrow(digest, "key binary, ends_sha256 string")


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(seqs: DataFrame) -> DataFrame:
    """A row for each node of the trie of seqs (conv_id bigint, turns array<struct<token, chars>>), the root included.

    A node is the first `depth` turns of its smallest member conv_id; parent_conv_id is its parent's (root: null). n_convs:
    members; n_children; n_leaves: childless nodes of its subtree; saved_tokens: characters that its subtree's turns need not
    be read again; ends_sha256: of the members that end there. A conversation without turns ends at the root. conv_ids must be
    there once each, as from sequences(); no conversations, no rows. A conversation's path (20 bytes a turn) is one row.
    """
    spark = seqs.sparkSession
    with batches_of(spark, RUN_ROWS):
        runs = stored(sorted_runs(seqs), "runs")
        nodes = stored(merged_nodes(runs, cuts_of(runs)), "nodes")
        dropped(runs)
        opened = nodes.filter(F.col("kind") == OPEN).groupBy("key", "parent", "depth", "chars").agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")))
        opened = stored(opened, "open")
        more = opened.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("more"))
        opened = opened.join(more, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more")
        shas = digests(nodes.filter(F.col("kind") == ENDS))
        opened = stored(whole_sums(opened).join(shas, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))), "open")
    # parents that are open: (key, conv_id)
    above = opened.select(F.col("key").alias("parent"), F.col("conv_id").alias("above"))
    complete = nodes.filter(F.col("kind") == COMPLETE).withColumnRenamed("ends", "ends_sha256")
    out = complete.filter(F.col("parent").isNull()).select(*COLUMNS)
    hang = complete.filter(F.col("parent").isNotNull()).drop("parent_conv_id").join(above, "parent")
    stems = opened.join(above, "parent", "left")
    for rows in (hang, stems):
        out = out.unionByName(rows.withColumnRenamed("above", "parent_conv_id").select(*COLUMNS))
    return out


def op12_conversation_trie(spark, sf_dir: str) -> DataFrame:
    seqs = stored(sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "sequences")
    return prefix_trie(rebuilt(seqs))


QUERIES = {"op12_conversation_trie": op12_conversation_trie}
SQL = {
    "op12_conversation_trie": """
        WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT DISTINCT conv_id FROM t),
        bits AS (SELECT conv_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda crc, b:
            list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)) AS crc FROM c),
        h AS (SELECT conv_id, xor(crc, 4294967295) % 6 AS h FROM bits),
        r AS (SELECT h.conv_id, t.i AS i, role, text FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 100 AND t.i < h.h
          UNION ALL SELECT h.conv_id, t.i, role, text FROM h JOIN t ON t.conv_id = h.conv_id AND t.i >= h.h),
        n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS d, length(text) AS chars, sha256(len(role) || ':' || role || text) AS x FROM r),
        p AS (SELECT conv_id, d, chars, string_agg(x, '') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM n UNION ALL SELECT conv_id, 0, 0, '' FROM c),
        last AS (SELECT conv_id, max(d) AS whole FROM p GROUP BY 1),
        node AS (SELECT path, d, chars, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (whole = d) AS ends FROM p JOIN last USING (conv_id) GROUP BY path, d, chars),
        node2 AS (SELECT *, left(path, length(path) - 64) AS up FROM node),
        kids AS (SELECT up AS path, count(*) AS n FROM node2 WHERE d > 0 GROUP BY 1),
        full_node AS (SELECT node2.*, coalesce(kids.n, 0) AS n_children FROM node2 LEFT JOIN kids USING (path)),
        ups AS (SELECT left(path, CAST(64 * k AS BIGINT)) AS path, n_children = 0 AS leaf, (n_convs - 1) * chars AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM full_node)),
        sums AS (SELECT path, count_if(leaf) AS n_leaves, sum(saved) AS saved FROM ups GROUP BY 1)
        SELECT a.conv_id, CAST(a.d AS BIGINT) AS depth, b.conv_id AS parent_conv_id, a.n_convs, CAST(a.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(a.ends, '')) AS ends_sha256
        FROM full_node a JOIN sums USING (path) LEFT JOIN node b ON a.d > 0 AND b.path = a.up
    """
}
