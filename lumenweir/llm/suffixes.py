"""Suffix-array dedup of byte strings: blockwise sorting of suffixes by a difference cover.

Only suffixes that agree over `size` bytes matter, so a suffix is known by its first `size` bytes. Suffixes at the places of
a difference cover (places p of a text with p mod v in the cover) are sorted first, one bucket at a time, and those whose
first size - v + 1 bytes occur again are ranked as tied. Any two places have, within the next v - 1 bytes, places of the
cover at the same distance; so two suffixes that agree over `size` bytes have a tied place of the cover there, and a suffix
without one needs no further sorting. The others are sorted in full, again one bucket at a time, in the order of the
documents. Suffixes are sorted by hashes of the bytes that count, since only ties matter and not the order between them.

Texts lie in blocks in the order of doc_id, so a suffix's document is known by its block: what a bucket needs of a suffix is a
name of 8 bytes (4 of a place of the cover), and what it returns to a block are the names that came before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweir.llm import words
from lumenweir.llm.common import batches_of, documents, dropped, dropped_table, sorted_table, stored

SIZE = 50
#: Text bytes of a block, what a row counts at least (copies have no body), and names that a bucket is meant to hold.
BLOCK_BYTES, ROW_BYTES = 1 << 22, 64
BUCKET_NAMES = 1 << 21
#: Documents of an Arrow batch.
DOC_ROWS = 200
#: Blocks of a bucket of the stored table of blocks, and its fewest and most buckets.
BUCKET_BLOCKS, LEAST_BUCKETS, MOST_BUCKETS = 2, 8, 100_000

#: Difference covers by their moduli: every difference modulo v is one of two members.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}

BLOCKED = "doc_id bigint, key bigint, body binary, rank bigint, block bigint"
NAMES = "bucket int, rank bigint, block bigint, names binary"
U = words.U
U4 = np.uint32


def cover_of(size: int) -> tuple[int, tuple[int, ...]]:
    """Modulus and members of the largest cover that leaves more than half of `size` bytes to a place of it."""
    v = max([v for v in COVERS if 2 * v <= size + 1], default=1)
    return v, COVERS.get(v, (0,))


def gram_hashes(buf: np.ndarray, at: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A 64-bit hash of the `size` bytes from each place."""
    base = 0x9E3779B97F4A7C15 if seed == 1 else 0xD1342543DE82EF95
    sums = np.empty(len(buf) + 1, U)
    sums[0] = 0
    np.cumsum(words._BYTES[seed][buf] * words.powers(base, len(buf)), out=sums[1:])
    return words.mixed((sums[at + size] - sums[at]) * words.powers(base, len(buf), True)[at])


class Texts:
    """Documents of a block, end to end, in runs of about 256 KB for the hashes."""

    RUN = 1 << 18

    def __init__(self, bodies: list[np.ndarray]) -> None:
        self.bodies = bodies
        self.lengths = np.array([len(x) for x in bodies], np.int64)

    def runs(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first document, bytes, offsets of the documents in them); a longer document is a run of its own."""
        i = 0
        while i < len(self.bodies):
            j = i + 1
            total = self.lengths[i]
            while j < len(self.bodies) and total + self.lengths[j] <= self.RUN:
                total += self.lengths[j]
                j += 1
            yield i, np.concatenate(self.bodies[i:j]), np.concatenate([[0], np.cumsum(self.lengths[i:j])])
            i = j


def starts(offs: np.ndarray, size: int) -> np.ndarray:
    """Places at which `size` bytes of one document start."""
    n = int(offs[-1])
    at = np.arange(n)
    return at[at + size <= np.repeat(offs[1:], np.diff(offs))]


def cover_places(offs: np.ndarray, size: int) -> np.ndarray:
    """Places of the cover, by their distance from the document's start, with the bytes that a place stands for."""
    v, members = cover_of(size)
    at = starts(offs, size - v + 1)
    inside = np.zeros(v, bool)
    inside[list(members)] = True
    return at[inside[(at - np.repeat(offs[:-1], np.diff(offs))[at]) % v]]


def cover_names(buf: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    at = cover_places(offs, size)
    return at, gram_hashes(buf, at, size - cover_of(size)[0] + 1, 1)


def split(names: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, its names) for sorted names, by their first `bits` bits."""
    if not len(names):
        return
    bucket = (names >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(names), np.int64)
    new = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    for a, b in zip(new.tolist(), [*new[1:].tolist(), len(names)], strict=True):
        yield int(bucket[a]), names[a:b]


def shortened(names: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits of a name after those of its bucket."""
    return (names << U(bits) >> U(32)).astype(U4)


def rows_of(kind: str, rows: list[tuple]) -> pa.RecordBatch:
    types = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in kind.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def body(x: pa.Scalar) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), np.uint8) if x.is_valid else np.empty(0, np.uint8)


def first_copies(docs: DataFrame) -> DataFrame:
    """docs (doc_id, key, text) with body: the bytes of the text, or null where a smaller doc_id has the same text, all of whose
    suffixes tie with that one's."""
    named = docs.withColumn("digest", F.unhex(F.sha2("text", 256))).withColumn("n_bytes", F.octet_length("text"))
    first = stored(named.groupBy("digest", "n_bytes").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")).filter("rows > 1").drop("rows"), "first")
    both = named.join(first, ["digest", "n_bytes"], "left")
    copy = F.col("first").isNotNull() & (F.col("doc_id") > F.col("first"))
    return both.select("doc_id", "key", F.when(~F.coalesce(copy, F.lit(False)), F.col("text").cast("binary")).alias("body"))


def blocked(docs: DataFrame) -> DataFrame:
    """docs (doc_id, key, body) in order of doc_id with rank and block: blocks of whole documents, about BLOCK_BYTES each.

    Ranks ascend with doc_id; a doc_id is of one rank. A rank is one block, but rows of one repeated doc_id that would fill a
    block alone are dealt to several blocks of one rank. A row counts ROW_BYTES at least, so that blocks of copies end too.
    """

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        rank, block, filled, last, ids = base, base, 0, None, 0
        for b in batches:
            ranks, blocks = [], []
            for key, x in zip(b.column("doc_id").to_pylist(), b.column("body"), strict=True):
                if ids and key != last and filled >= BLOCK_BYTES:
                    rank, block, filled, ids = rank + 1, block + 1, 0, 0
                elif ids == 1 and key == last and filled >= BLOCK_BYTES:
                    block, filled = block + 1, 0
                ids += ids == 0 or key != last
                last = key
                filled += max(ROW_BYTES, len(body(x)))
                ranks.append(rank)
                blocks.append(block)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ranks, pa.int64()), pa.array(blocks, pa.int64())], [*b.schema.names, "rank", "block"])

    return docs.repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id")).mapInArrow(assign, BLOCKED)


def block_table(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs as a table that is bucketed by block, so that what buckets return meets the texts where they are; and their bytes."""
    flat = stored(docs.withColumn("n_bytes", F.octet_length("body")), "blocked")
    n_bytes = flat.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, n_bytes // (BUCKET_BLOCKS * BLOCK_BYTES)))
    out = sorted_table(flat.drop("n_bytes").repartition(buckets, "block"), "blocks", "block", buckets)
    dropped(flat)
    return out, n_bytes


def bits_for(names: int) -> int:
    """Buckets as a power of 2, so that each has about BUCKET_NAMES."""
    return max(4, (names // BUCKET_NAMES).bit_length())


def tied_places(docs: DataFrame, size: int, bits: int) -> DataFrame:
    """block, bucket, names: the places of the cover in each block whose bytes occur at another place of it, by 32-bit names in a bucket."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank, block = b.column("rank").to_numpy(), b.column("block").to_numpy()
            out = []
            for x in np.unique(block):
                own = np.flatnonzero(block == x)
                names = [cover_names(buf, offs, size)[1] for _, buf, offs in Texts([body(b.column("body")[int(i)]) for i in own]).runs()]
                names = np.sort(np.concatenate(names))
                two = np.ones(len(names), bool)  # of more than two alike two; a batch of short texts has no names
                two[2:] = names[2:] != names[:-2]
                names = names[two]
                out += [(k, int(rank[own[0]]), int(x), shortened(n, bits).tobytes()) for k, n in split(names, bits)]
            yield rows_of(NAMES, out)

    def ties(table: pa.Table) -> pa.Table:
        own = [np.frombuffer(x.as_buffer(), U4) for x in table["names"]]
        every = np.sort(np.concatenate(own))
        tied = every[1:][every[1:] == every[:-1]]
        tied = tied[np.concatenate([[True], tied[1:] != tied[:-1]])] if len(tied) else tied
        out = []
        for bucket, rank, block, names in zip(table["bucket"].to_pylist(), table["rank"].to_pylist(), table["block"].to_pylist(), own, strict=True):
            hit = names[_member(names, tied)]
            if len(hit):
                out.append((bucket, rank, block, hit.tobytes()))
        return pa.Table.from_batches([rows_of(NAMES, out)])

    return docs.select("rank", "block", "body").mapInArrow(each, NAMES).groupBy("bucket").applyInArrow(ties, NAMES)


def _member(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which of x are in `of`, which is sorted."""
    if not len(of):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(of, x), len(of) - 1)
    return of[at] == x


class Answers:
    """Names that buckets have returned to a block, by bucket."""

    def __init__(self, table: pa.Table, kind: type, bits: int) -> None:
        self.bits = bits
        lists: dict[int, list[np.ndarray]] = {}
        for bucket, names in zip(table["bucket"].to_pylist(), table["names"], strict=True):
            lists.setdefault(bucket, []).append(np.frombuffer(names.as_buffer(), kind))
        shift = U(bits) if kind is U4 else U(0)
        whole = [(np.concatenate(v).astype(U) << U(32) >> shift if kind is U4 else np.concatenate(v)) | (U(k) << U(64 - bits) if kind is U4 else U(0)) for k, v in lists.items()]
        self.names = np.unique(np.concatenate(whole)) if whole else np.empty(0, U)
        self.mask = ~U((1 << (32 - bits)) - 1) if kind is U4 else ~U(0)

    def have(self, names: np.ndarray) -> np.ndarray:
        return _member(names & self.mask, self.names)


def untied_out(table: pa.Table, answers: Answers, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document's number in the table, place, name) of the block's suffixes that have a tied place of the cover within reach."""
    v = cover_of(size)[0]
    for first, buf, offs in Texts([body(x) for x in table["body"]]).runs():
        at, names = cover_names(buf, offs, size)
        tied = at[answers.have(names)]
        if not len(tied):
            continue
        edge = np.zeros(len(buf) + 1, np.int32)
        np.add.at(edge, np.maximum(tied - (v - 1), 0), 1)
        np.add.at(edge, tied + 1, -1)
        at = starts(offs, size)
        at = at[np.cumsum(edge)[at] > 0]
        of = np.searchsorted(offs, at, "right") - 1
        yield of + first, at - offs[of], gram_hashes(buf, at, size, 2)


def earlier_names(docs: DataFrame, tied: DataFrame, size: int, bits: int, wide: int) -> DataFrame:
    """bucket, rank, block, names: the names of suffixes of each rank that occur in a smaller rank too."""

    def each(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([rows_of(NAMES, [])])
        names = [n for _, _, n in untied_out(left, Answers(right, U4, bits), size)]
        names = np.unique(np.concatenate(names)) if names else np.empty(0, U)
        rank = left["rank"][0].as_py()
        return pa.Table.from_batches([rows_of(NAMES, [(k, rank, key[0].as_py(), n.tobytes()) for k, n in split(names, wide)])])

    def ranked(table: pa.Table) -> pa.Table:
        own = [np.frombuffer(x.as_buffer(), U) for x in table["names"]]
        ranks, of = np.unique(table["rank"].to_numpy(), return_inverse=True)
        names, of = np.concatenate(own), np.repeat(of.astype(np.int32), [len(x) for x in own])
        order = np.lexsort((of, names))
        names, of = names[order], of[order]
        new = np.concatenate([[True], names[1:] != names[:-1]])
        least = of[np.flatnonzero(new)][np.cumsum(new) - 1]
        late = np.empty(len(names), bool)
        late[order] = of > least
        out, at = [], 0
        for bucket, rank, block, x in zip(table["bucket"].to_pylist(), table["rank"].to_pylist(), table["block"].to_pylist(), own, strict=True):
            hit = x[late[at : at + len(x)]]
            at += len(x)
            if len(hit):
                out.append((bucket, rank, block, hit.tobytes()))
        return pa.Table.from_batches([rows_of(NAMES, out)])

    asked = docs.select("rank", "block", "body").groupBy("block").cogroup(tied.groupBy("block")).applyInArrow(each, NAMES)
    return asked.groupBy("bucket").applyInArrow(ranked, NAMES)


CUT = "key bigint, starts array<int>, stops array<int>"


def removed_spans(docs: DataFrame, tied: DataFrame, earlier: DataFrame, size: int, bits: int, wide: int) -> DataFrame:
    """key, starts, stops: the removed runs of bytes of each document that loses some."""

    def each(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        kind = pa.schema([("key", pa.int64()), ("starts", pa.list_(pa.int32())), ("stops", pa.list_(pa.int32()))])
        late = right["late"].to_numpy()
        if not left.num_rows or late.all():
            return kind.empty_table()
        before = Answers(right.filter(pa.array(late)), U, wide)
        own, at, names = [], [], []
        for d, p, n in untied_out(left, Answers(right.filter(pa.array(~late)), U4, bits), size):
            own.append(d)
            at.append(p)
            names.append(n)
        if not own:
            return kind.empty_table()
        own, at, names = np.concatenate(own), np.concatenate(at), np.concatenate(names)
        if not len(names):  # ties in texts of less than `size` bytes only
            return kind.empty_table()
        # within the block: documents in order of doc_id, a null one first and all rows of one doc_id alike
        ids = left["doc_id"].to_pylist()
        place = {x: i for i, x in enumerate(sorted(set(ids), key=lambda x: (x is not None, x or 0)))}
        of = np.array([place[x] for x in ids], np.int32)[own]
        order = np.lexsort((of, names))
        new = np.concatenate([[True], names[order][1:] != names[order][:-1]])
        gone = np.empty(len(names), bool)
        gone[order] = of[order] > of[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        gone |= before.have(names)
        own, at = own[gone], at[gone].astype(np.int64)
        out: list[tuple] = []
        bounds = np.searchsorted(own, np.arange(left.num_rows + 1))
        for i in range(left.num_rows):
            p = at[bounds[i] : bounds[i + 1]]
            if len(p):
                new = np.concatenate([[True], p[1:] > p[:-1] + size])
                out.append((left["key"][i].as_py(), p[new].tolist(), (p[np.append(new[1:], True)] + size).tolist()))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kind.types, strict=True)], schema=kind) if out else kind.empty_table()

    answers = tied.withColumn("late", F.lit(False)).unionByName(earlier.withColumn("late", F.lit(True)))
    return docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(each, CUT)


def without_repeated_bytes(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_bytes, n_removed, removed array<struct<start, end>> (maximal runs of bytes, end exclusive), kept binary (the
    remaining bytes) for every row and whole text, as UTF-8 bytes.

    A byte goes if a string of `size` bytes that covers it also starts in a document with a smaller doc_id; strings are judged
    on the input and lie within one document. Null text: empty. A null doc_id is smaller than all others. Rows of one doc_id
    don't remove from each other; equal rows share their fate. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("doc_id", "text").alias("key"), "text")
    with batches_of(spark, DOC_ROWS):
        # null doc_ids are made the least ones, as min() skips nulls
        least = F.coalesce("doc_id", F.lit(-(1 << 63)))
        v, members = cover_of(size)
        whole, n_bytes = block_table(blocked(first_copies(rows.withColumn("doc_id", least))))
        bits, wide = bits_for(n_bytes * len(members) // v), bits_for(n_bytes // 3)
        tied = stored(tied_places(whole, size, bits), "tied")
        earlier = stored(earlier_names(whole, tied, size, bits, wide), "earlier")
        cuts = stored(removed_spans(whole, tied, earlier, size, bits, wide), "cuts")
        copies = stored(whole.filter(F.col("body").isNull()).select("key").distinct(), "copies")
        dropped_table(whole)
        for t in (tied, earlier):
            dropped(t)
    return kept_bytes(rows, cuts, copies, size).withColumn("doc_id", F.col("doc_id").cast(kind))


def kept_bytes(rows: DataFrame, cuts: DataFrame, copies: DataFrame, size: int) -> DataFrame:
    """The documents without the bytes that the cuts of their key remove; a copy of an earlier text loses all, if it has `size` bytes."""
    spans = cuts.groupBy("key").agg(F.first("starts").alias("starts"), F.first("stops").alias("stops"))
    both = rows.withColumn("body", F.col("text").cast("binary")).drop("text").join(spans, "key", "left").join(copies.withColumn("copy", F.lit(True)), "key", "left")
    n = F.octet_length("body")
    pair = lambda x: F.struct(x["starts"].cast("bigint").alias("start"), x["stops"].cast("bigint").alias("end"))
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), n.cast("bigint").alias("end")))
    removed = F.when(F.col("copy") & (n >= size), whole).when(F.col("starts").isNotNull(), F.transform(F.arrays_zip("starts", "stops"), pair)).otherwise(none)
    out = both.withColumn("removed", removed).withColumn("n_bytes", n.cast("bigint"))
    gone = F.aggregate("removed", F.lit(0).cast("bigint"), lambda t, x: t + x["end"] - x["start"])
    # kept pieces: from each removed run's end (and the start) to the next run's start (and the end)
    begins = F.concat(F.array(F.lit(0).cast("bigint")), F.col("removed.end"))
    ends = F.concat(F.col("removed.start"), F.array(F.col("n_bytes")))
    pieces = F.transform(F.arrays_zip(begins.alias("a"), ends.alias("z")), lambda x: F.hex(F.substring(F.col("body"), x["a"].cast("int") + 1, (x["z"] - x["a"]).cast("int"))))
    kept = F.when(F.size("removed") == 0, F.col("body")).otherwise(F.unhex(F.array_join(pieces, "")))
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), "removed", kept.alias("kept"))


def op13_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    done = without_repeated_bytes(documents(spark, sf_dir))
    return done.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op13_suffix_dedup": op13_suffix_dedup}
SQL = {}
