"""MinHash near-dedup: a chosen-path set-similarity join over word shingles, then connected components.

Documents with equal shingle sets form classes. In each of TREES independent trees the classes start in one node, which
branches by the value of one minwise coordinate. A child of LEAF classes or fewer is a leaf, compared exhaustively: first
by minwise signatures and then, if those are near, on full sets. A pair is confirmed in the first tree in which it meets,
and a leaf emits a forest of its links, not all pairs. A pair of similarity s meets in a tree with probability s, so TREES
trees miss it with probability (1 - s)^TREES.

Larger children are settled in two steps. First every class is compared with a few hubs of its node and with its block of
LEAF classes, which connects a crowd of near copies at the cost of a leaf. Then only pairs that no link connects yet matter,
so a node
- whose classes are all connected is done;
- with at most LEAF classes outside its largest component compares those with all its blocks, exhaustively;
- of at most WHOLE classes compares all pairs of its blocks, exhaustively;
- that is still larger branches on by one more coordinate a class, in REPEATS independent subtrees, and its children are
  settled alike; after LEVELS further levels all pairs of blocks are compared whatever the size.
Each level deals a class to one child a subtree, so rows grow with the classes and not with the square of a crowd.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweir.llm import words
from lumenweir.llm.bitmap import bitmap_of
from lumenweir.llm.common import chunked, documents, dropped, stored, whole_texts
from lumenweir.operators.components import components

WORDS = 5
#: Similarity of a link in percent, unless another is given.
PERCENT = 85
TREES = 10
#: Minwise coordinates of a signature.
COORDINATES = 64
#: Classes of a leaf or block; classes of a node whose blocks are all compared with each other; hubs of a larger node (about).
LEAF = 128
WHOLE = 8 * LEAF
HUBS = 16
#: Independent subtrees of a node larger than WHOLE that holds unconnected classes, and the most levels of them.
REPEATS = 3
LEVELS = 32

_RANDOM = np.random.Generator(np.random.PCG64(20_011)).integers(0, 1 << 63, COORDINATES, dtype=np.uint64) | np.uint64(1)
_SHORT = np.random.Generator(np.random.PCG64(20_021)).integers(0, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def shingles(buf: np.ndarray, offs: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text in ascending order, one text after another, and their numbers.

    A-Z are lower-cased. A text of fewer words than `size` has its whole sequence as the only shingle; without words none.
    """
    buf = words.LOWER[buf]
    starts, ends, first = words.spans(buf, offs)
    h = words.hashes(buf, starts, ends)
    n_words = np.diff(first)
    at = words.inside_text(first, size)
    owner = np.repeat(np.arange(len(n_words)), n_words)[at]
    value = words.windows(h, size)[at] if len(at) else np.empty(0, words.U)
    few = np.flatnonzero((n_words > 0) & (n_words < size))
    if len(few):
        whole = np.zeros(len(few), words.U)
        for j in range(size - 1):
            has = n_words[few] > j
            whole[has] += h[first[few[has]] + j] * _SHORT[j]
        owner, value = np.concatenate([owner, few]), np.concatenate([value, words.mixed(whole + n_words[few].astype(words.U))])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return value[new], np.bincount(owner[new], minlength=len(n_words))


def signatures(value: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minwise signature (n x COORDINATES, 32 bits) and 128-bit name of each set; zeros for an empty set."""
    some = np.flatnonzero(sizes)
    begin = (np.cumsum(sizes) - sizes)[some]
    sig = np.zeros((len(sizes), COORDINATES), np.uint32)
    name = np.zeros((len(sizes), 2), words.U)
    if len(some):
        for k in range(COORDINATES):
            sig[some, k] = np.minimum.reduceat(((value * _RANDOM[k]) >> np.uint64(32)).astype(np.uint32), begin)
        for k in range(2):
            name[some, k] = np.add.reduceat(words.mixed(value + _SHORT[10 + k]), begin)
    return sig, name


def described(docs: DataFrame) -> DataFrame:
    """doc_id, n, a, b (the set's name), sig array<int>, low (the last byte of each coordinate): one row for each row of docs."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, end, buf, offs in chunked(b.column("text")):
                value, sizes = shingles(buf, offs)
                sig, name = signatures(value, sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, COORDINATES, dtype=np.int32)), pa.array(sig.ravel().view(np.int32)))
                low = pa.array([x.tobytes() for x in sig.astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, end - at), pa.array(sizes.astype(np.int64)), pa.array(name[:, 0].view(np.int64)), pa.array(name[:, 1].view(np.int64)), lists, low], ["doc_id", "n", "a", "b", "sig", "low"])

    return docs.mapInArrow(describe, "doc_id bigint, n bigint, a bigint, b bigint, sig array<int>, low binary")


def branch(tree: Column, node: Column, level: int, value: Callable[[Column], Column]) -> Column:
    """The child of a class in a node: the node's hash chooses the coordinate (the tree's number at the root), whose value branches."""
    pick = F.pmod(F.xxhash64(tree, node, F.lit(level)), F.lit(COORDINATES)).cast("int") if level else F.pmod(tree * 7, F.lit(COORDINATES))
    return F.xxhash64(tree, node, pick, value(pick + 1))


def blocks_of(size: Column) -> Column:
    """Blocks of about LEAF classes: a power of 2, so that a class has the same block in nodes of like size in all trees."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.greatest(F.ceil(F.log2(size / F.lit(LEAF))), F.lit(0)).cast("int"))


def leaves(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """tree, leaf, cid of all nodes under the roots with two classes or more, of about LEAF + 2 * HUBS rows at most; and tree,
    node, cid of the nodes larger than LEAF, whose leaves here are their blocks, each with the node's hubs."""
    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    rows = classes.select("cid", "sig", trees).select("tree", branch(F.col("tree"), F.lit(0).cast("bigint"), 0, lambda i: F.element_at("sig", i)).alias("node"), "cid")
    rows = stored(rows, "nodes")
    sizes = stored(rows.groupBy("tree", "node").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
    # sizes has one row a node, so each row comes out once; rows alone in their node come out without a size
    both = stored(rows.join(sizes, ["tree", "node"], "left"), "sized")
    small = both.filter(F.col("size") <= LEAF).select("tree", F.col("node").alias("leaf"), "cid")
    large = both.filter(F.col("size") > LEAF).withColumn("blocks", blocks_of(F.col("size")))
    own = F.pmod(F.xxhash64("cid"), F.col("blocks"))
    hub = F.pmod(F.xxhash64("cid", F.lit(1)), F.col("blocks") * LEAF) < HUBS
    block = F.explode(F.when(hub, F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).otherwise(F.array(own))).alias("block")
    dealt = large.select("tree", "node", "cid", block).select("tree", F.xxhash64("tree", "node", "block").alias("leaf"), "cid")
    out = stored(small.unionByName(dealt), "leaves")
    crowds = stored(large.select("tree", "node", "cid"), "crowds")
    for t in (rows, sizes, both):
        dropped(t)
    return out, crowds


def settled(crowds: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """tree, leaf, cid, n, seen, low: leaves in which all pairs of the nodes of crowds (tree, node, cid) that labels don't
    connect meet, or for nodes larger than WHOLE meet with the probability of the subtrees.

    seen holds what a class is connected with, then its node in each subtree if all its pairs are compared there.
    """
    of = classes.select("cid", "n", "low").join(labels.select(F.col("node").alias("cid"), "label"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    carried = ["cid", "n", "label", "low"]
    rows = stored(crowds.join(of, "cid").select((F.col("tree") * REPEATS).alias("tree"), "node", *carried), "rows")
    out, kept = None, [rows]
    for level in range(1, LEVELS + 2):
        each = rows.groupBy("tree", "node", "label").agg(F.count("*").alias("k"))
        nodes = each.groupBy("tree", "node").agg(F.sum("k").alias("size"), F.max(F.struct("k", "label")).alias("top")).filter("size > top.k")
        nodes = nodes.select("tree", "node", "size", (F.col("size") - F.col("top.k")).alias("rest"), F.col("top.label").alias("main"))
        size, last = F.col("size"), level > LEVELS
        how = F.when(size <= 2 * LEAF, "leaf").when(F.col("rest") <= LEAF, "star").when(F.lit(last) | (size <= WHOLE), "pairs").otherwise("deep")
        blocks = F.when(F.col("how") == "pairs", F.ceil(size / (2 * LEAF)).cast("bigint")).otherwise(blocks_of(size))
        nodes = stored(nodes.withColumn("how", how).withColumn("blocks", blocks), "open")
        kept.append(nodes)
        block = F.pmod(F.xxhash64("cid"), F.col("blocks"))
        every = F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)
        name = lambda *by: F.xxhash64("tree", "node", *by)
        leaf = (
            F.when((F.col("how") == "leaf") | (F.col("blocks") == 1), F.array(F.col("node")))
            .when(F.col("how") == "star", F.transform(F.when(F.col("label") == F.col("main"), F.array(block)).otherwise(every), lambda x: name(x)))
            .otherwise(F.transform(F.filter(every, lambda x: x != block), lambda x: name(F.least(x, block), F.greatest(x, block))))
        )
        # rows of deep nodes go on by a filter, without a shuffle: such a node has more than WHOLE rows, so its name is broadcast;
        # the others meet their node here, so a class is joined once a subtree at most, however deep it gets
        inner = nodes.filter("how = 'deep'").select("tree", "node")
        ends = rows.join(F.broadcast(inner), ["tree", "node"], "left_anti").join(nodes.filter("how <> 'deep'"), ["tree", "node"])
        here = ends.select("tree", "node", leaf.alias("leaf"), *carried)
        out = here if out is None else out.unionByName(here)
        if inner.isEmpty():
            break
        deep = rows.join(F.broadcast(inner), ["tree", "node"], "left_semi")
        if level == 1:
            deep = deep.withColumn("tree", F.explode(F.sequence(F.col("tree"), F.col("tree") + REPEATS - 1)))
        child = branch(F.col("tree"), F.col("node"), level, lambda i: F.substring(F.col("low"), i, F.lit(1)))
        rows = stored(deep.select("tree", child.alias("node"), *carried), "rows")
        kept.append(rows)
    out = stored(out, "settled")
    slots = (F.coalesce(F.max(F.when(F.col("tree") == k, F.col("node"))), F.lit(0).cast("bigint")) for k in range(TREES * REPEATS))
    seen = out.groupBy("cid").agg(F.concat(F.array(F.xxhash64(F.first("label"))), F.array(*slots)).alias("seen"))
    met = out.join(seen, "cid").select((F.col("tree") + 1).alias("tree"), F.explode("leaf").alias("leaf"), "cid", "n", "seen", "low")
    met = stored(met, "pairs")
    for t in (*kept, out):
        dropped(t)
    return met


def screen(percent: int) -> float:
    """The share of equal coordinates below which a pair isn't compared on full sets: five standard deviations under the threshold."""
    s = percent / 100
    return np.floor(100 * (s - 5 * (s * (1 - s) / COORDINATES) ** 0.5)) / 100


def by_leaf(batches: Iterator[pa.RecordBatch], use: Callable[[pa.Table], pa.Table | None]) -> Iterator[pa.RecordBatch]:
    """Call `use` on the rows of each leaf, from batches sorted by (tree, leaf); a leaf may run over several batches."""
    rest: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        rest = t if rest is None else pa.concat_tables([rest, t])
        tree, leaf = rest["tree"].to_numpy(), rest["leaf"].to_numpy()
        cut = np.flatnonzero((tree[1:] != tree[:-1]) | (leaf[1:] != leaf[:-1])) + 1
        if len(cut):
            rest = rest.combine_chunks()
            for a, z in zip([0, *cut[:-1]], cut, strict=True):
                if (out := use(rest.slice(a, z - a))) is not None:
                    yield from out.to_batches()
            rest = rest.slice(cut[-1])
    if rest is not None and len(rest) and (out := use(rest)) is not None:
        yield from out.to_batches()


def _open(sizes: np.ndarray, seen: np.ndarray, tree: int, percent: int) -> np.ndarray:
    """Pairs of a leaf (upper triangle) that may reach the threshold by size and met in no earlier tree."""
    ok = np.minimum.outer(sizes, sizes) * 100 >= percent * np.maximum.outer(sizes, sizes)
    for k in range(tree):
        col = seen[:, k]
        ok &= (col[:, None] != col[None, :]) | (col == 0)[:, None]
    return np.triu(ok, 1)


def _lists(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    c = column.combine_chunks()
    return c.flatten().to_numpy().view(kind).reshape(len(c), -1)


def near_in_leaf(t: pa.Table, percent: int) -> pa.Table | None:
    """The classes of a leaf that have a partner near by signature which they have not met before."""
    if len(t) < 2:
        return None
    ok = _open(t["n"].to_numpy(), _lists(t["seen"], np.int64), int(t["tree"][0].as_py()), percent)
    if not ok.any():
        return None
    sig = np.frombuffer(b"".join(t["low"].to_pylist()), np.uint64).reshape(len(t), -1).view(np.uint8)
    i, j = np.nonzero(ok)
    close = np.zeros(len(i), bool)
    for a in range(0, len(i), 4096):
        close[a : a + 4096] = (sig[i[a : a + 4096]] == sig[j[a : a + 4096]]).mean(axis=1) >= screen(percent)
    some = np.unique(np.concatenate([i[close], j[close]]))
    return t.select(["tree", "leaf", "cid", "n", "seen"]).take(pa.array(some)) if len(some) else None


def shared_counts(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections of sets of hashes: products of 0/1 matrices over the hashes that two sets or more have."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    many = count[at] > 1
    owner, at = owner[many], (np.cumsum(count > 1) - 1)[at[many]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((len(sets), len(sets)))
    for first in range(0, int(at[-1]) + 1 if len(at) else 0, columns):
        a, z = np.searchsorted(at, [first, first + columns])
        has = np.zeros((len(sets), columns), np.float32)
        has[owner[a:z], at[a:z] - first] = 1
        out += has @ has.T
    return out


def links_in_leaf(t: pa.Table, percent: int) -> pa.Table | None:
    """A forest of the links of a leaf, each confirmed on the full sets."""
    if len(t) < 2:
        return None
    sizes, cid = t["n"].to_numpy(), t["cid"].to_numpy()
    ok = _open(sizes, _lists(t["seen"], np.int64), int(t["tree"][0].as_py()), percent)
    shared = shared_counts([np.frombuffer(x.as_buffer(), np.uint64) for x in t["shingles"]])
    ok &= 100 * shared >= percent * (np.add.outer(sizes, sizes) - shared)
    root = list(range(len(t)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    left, right = [], []
    for i, j in zip(*np.nonzero(ok), strict=True):
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            left.append(cid[i])
            right.append(cid[j])
    return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())}) if left else None


def in_leaves(df: DataFrame, use: Callable[[pa.Table], pa.Table | None], kind: str) -> DataFrame:
    """Deal rows by (tree, leaf), and call `use` on each leaf."""
    return df.repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", "cid").mapInArrow(lambda it: by_leaf(it, use), kind)


def class_links(docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between classes (cid) that link every pair of classes at or over the threshold, by a path at least."""
    met, crowds = leaves(classes)
    # a leaf of each class in each tree (0: none): a pair that shares one has met in that tree, and needs no further comparison
    last = F.array(*(F.coalesce(F.max(F.when(F.col("tree") == k, F.col("leaf"))), F.lit(0).cast("bigint")) for k in range(TREES)))
    info = stored(classes.join(met.groupBy("cid").agg(last.alias("seen")), "cid").select("cid", "n", "seen", "low"), "info")
    out = confirmed(docs, classes, met.join(info, "cid"), percent)
    for t in (met, info):
        dropped(t)
    if not crowds.isEmpty():
        labels = components(out)
        met = settled(crowds, classes, labels)
        if not met.isEmpty():
            more = confirmed(docs, classes, met, percent)
            both = stored(out.unionByName(more), "links")
            for t in (out, more):
                dropped(t)
            out = both
        dropped(labels)
        dropped(met)
    dropped(crowds)
    return out


def confirmed(docs: DataFrame, classes: DataFrame, met: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b): the links of the leaves in met (tree, leaf, cid, n, seen, low), but for pairs that share what seen holds
    under an earlier tree's number."""
    spark = docs.sparkSession
    near = in_leaves(met, lambda t: near_in_leaf(t, percent), "tree int, leaf bigint, cid bigint, n bigint, seen array<bigint>")
    near = stored(near, "near")
    wanted = stored(near.select("cid").distinct(), "wanted")
    shipped = spark.sparkContext.broadcast(bitmap_of(wanted, F.xxhash64("cid"), wanted.count()))

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = shipped.value
        for b in batches:
            hit = np.flatnonzero(sieve.has(b.column("h").to_numpy().view(np.uint64)))
            b = b.take(pa.array(hit))
            for at, end, buf, offs in chunked(b.column("text")):
                value, sizes = shingles(buf, offs)
                _, name = signatures(value, sizes)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                sets = [value[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, end - at), pa.array(name[:, 0].view(np.int64)), pa.array(name[:, 1].view(np.int64)), pa.array(sets, pa.binary())], ["cid", "a", "b", "shingles"])

    rows = docs.filter("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("doc_id").alias("h"))
    sets = rows.mapInArrow(full_sets, "cid bigint, a bigint, b bigint, shingles binary")
    named = classes.join(wanted, "cid", "left_semi").select("cid", "a", "b")
    sets = sets.join(named, ["cid", "a", "b"]).groupBy("cid").agg(F.first("shingles").alias("shingles"))
    sets = stored(sets, "sets")
    found = in_leaves(near.join(sets, "cid"), lambda t: links_in_leaf(t, percent), "a bigint, b bigint")
    out = stored(found.distinct(), "links")
    for t in (near, wanted, sets):
        dropped(t)
    return out


def near_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs; links are pairs of a similarity of percent or more.

    Null texts and texts without words have no shingles and are linked with nothing. Rows of one doc_id are one document
    to the links (of several texts the one with the smallest set stands for it); rows with null doc_id can't be named: their component_id is null and they are kept. Repeated rows get
    the same answer. Equal sets are one class and never compared; ties don't arise, as any order of comparisons gives the
    same components. Empty table: empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    whole_texts(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = stored(described(docs), "described")
    full = rows.filter("n > 0 AND doc_id IS NOT NULL")
    names = stored(full.groupBy("n", "a", "b").agg(F.min("doc_id").alias("cid")), "names")
    one = full.join(names.withColumnRenamed("cid", "doc_id"), ["n", "a", "b", "doc_id"])
    least = F.min(F.struct("n", "a", "b", "sig", "low")).alias("s")
    classes = stored(one.groupBy(F.col("doc_id").alias("cid")).agg(least).select("cid", "s.*"), "classes")
    links = class_links(docs, classes, percent)
    labels = components(links)
    of = names.join(labels, names["cid"] == labels["node"], "left").select("n", "a", "b", F.coalesce("label", "cid").alias("label"))
    of = stored(of, "of")
    out = rows.drop("sig", "low").join(of, ["n", "a", "b"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id")).alias("component_id"))
    for t in (names, classes, links, labels):
        dropped(t)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stay when of each near-duplicate component one document does, that of the least doc_id.

    Documents are told apart by doc_id; where several rows have one doc_id or none, by (doc_id, text), and such a document
    stays only for want of one with a doc_id of its own. Equal rows share their fate. Rows without words stay. An empty
    table gives an empty result; all columns pass through, whatever their names.
    """
    key = "_near" + "_" * max(map(len, docs.columns))
    own = docs.withColumn(key, F.col("doc_id").cast("bigint"))
    shared = stored(docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").select(F.col("doc_id").alias(key + "i")), "shared")
    if not shared.isEmpty():  # else texts need not move to their names
        other = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2) + F.lit(1 << 62)  # above all doc_ids: 62 bits of a hash
        of = own.join(shared.withColumn(key + "s", F.lit(True)), F.col("doc_id").eqNullSafe(F.col(key + "i")), "left")
        own = stored(of.withColumn(key, F.when(F.col(key + "s"), other).otherwise(F.col(key))).drop(key + "i", key + "s"), "named")
    gone = near_groups(own.select(F.col(key).alias("doc_id"), "text"), percent).filter("NOT kept").select(F.col("doc_id").alias(key + "g")).distinct()
    return own.join(stored(gone, "gone"), F.col(key) == F.col(key + "g"), "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def op1_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))


QUERIES = {"op1_near_dedup": op1_near_dedup}
#: All pairs that share a shingle, compared in full, then the closure; for small tables.
SQL = {
    "op1_near_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
        m AS (SELECT doc_id, count(*) AS m FROM g GROUP BY 1),
        sh AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM sh JOIN m x ON x.doc_id = a JOIN m y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.m + y.m - shared)),
        both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach(n, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.n, both_ways.b FROM reach JOIN both_ways ON reach.v = both_ways.a),
        roots AS (SELECT n AS doc_id, min(v) AS root FROM reach GROUP BY 1)
        SELECT doc_id, coalesce(m, 0) AS n_shingles, root AS component_id, doc_id = root AS kept FROM roots LEFT JOIN m USING (doc_id)
    """
}
