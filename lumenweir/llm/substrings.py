"""Substring dedup: words inside passages of WINDOW words that start more than once in the corpus are removed.

A log-structured index holds fingerprints of windows: a window's fingerprint is the least hash of the SEED-word runs in it,
so equal windows have equal fingerprints, and a text has about one distinct fingerprint for each dozen of its windows. Each
batch of documents becomes an immutable run, a table bucketed and sorted by fingerprint; the run is merge-joined with the
runs before it, without a shuffle, and runs are compacted into one when there are too many. What the joins find, and what
repeats within a batch, is all that can belong to a repeated window. The windows of those fingerprints are verified on
hashes of all their words, and only exact repeats are removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweir.llm import words
from lumenweir.llm.bitmap import bitmap_of
from lumenweir.llm.common import chunked, documents, dropped, dropped_table, sorted_table, stored, whole_texts

WINDOW = 35
SEED = 12
#: Batches that the query cuts the corpus into, and runs that an index holds before it compacts them.
BATCHES = 6
MOST_RUNS = 4
#: Fingerprints that a bucket of a run is meant to hold, and the fewest buckets.
BUCKET_ROWS, LEAST_BUCKETS = 500_000, 8
#: Repeated fingerprints that are broadcast as a bitmap, at most; more are joined with the documents' own fingerprints.
MOST_SHIPPED = 1 << 21


def _slide(x: np.ndarray, size: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each `size` consecutive values, by doubling."""
    have = 1
    while 2 * have <= size:
        x = pick(x[:-have], x[have:])
        have *= 2
    return x if have == size else pick(x[: len(x) - (size - have)], x[size - have :])


def fingerprints(word_hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word index of each whole window, its fingerprint, the fingerprints at their places: one for each place that is some window's least)."""
    none = np.empty(0, words.U)
    at = words.inside_text(first, size)
    if not len(at):
        return at, none, none
    seed = min(SEED, size)
    span = size - seed + 1
    runs = words.windows(word_hashes, seed)
    least = _slide(runs, span, np.minimum)
    whole = np.zeros(len(runs) + span - 1, words.U)
    whole[span - 1 + at] = least[at]
    return at, least[at], runs[_slide(whole, span, np.maximum) == runs]


def window_counts(docs: DataFrame, size: int, batch: Column | None = None) -> DataFrame:
    """batch, fp, n: how many places of docs have each fingerprint, summed within each Arrow batch; a fingerprint has several rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, of = [], []
            own = b.column("batch").to_numpy()
            for at, end, buf, offs in chunked(b.column("text")):
                starts, ends, first = words.spans(buf, offs)
                h = words.hashes(buf, starts, ends)
                for k in np.unique(own[at:end]):
                    whole = own[at:end] == k
                    if whole.all():
                        _, _, fp = fingerprints(h, first, size)
                    else:
                        inside = np.repeat(whole, np.diff(first))
                        _, _, fp = fingerprints(h[inside], np.concatenate([[0], np.cumsum(np.where(whole, np.diff(first), 0))]), size)
                    parts.append(fp)
                    of.append(np.full(len(fp), k, np.int32))
            if not parts:
                continue
            fp, k = np.concatenate(parts), np.concatenate(of)
            order = np.lexsort((fp, k))
            fp, k = fp[order], k[order]
            new = np.flatnonzero(np.concatenate([[True], (fp[1:] != fp[:-1]) | (k[1:] != k[:-1])])) if len(fp) else np.empty(0, np.int64)
            n = np.diff(np.append(new, len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(k[new]), pa.array(fp[new].view(np.int64)), pa.array(n.astype(np.int64))], ["batch", "fp", "n"])

    batch = F.lit(0) if batch is None else batch
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), batch.cast("int").alias("batch"))
    return rows.mapInArrow(count, "batch int, fp bigint, n bigint")


class FingerprintIndex:
    """Sorted immutable runs of window fingerprints in the shared folder, bucketed alike so that two of them merge in place.

    append() makes a run of a batch and returns the fingerprints of the batch that repeat within it or occur in earlier
    runs; repeated() gives those of all batches so far. Runs are never changed: compact() writes a new one.
    """

    def __init__(self, size: int = WINDOW, most_runs: int = MOST_RUNS, buckets: int = LEAST_BUCKETS) -> None:
        self.size, self.most_runs, self.buckets = size, most_runs, buckets
        self.runs: list[DataFrame] = []
        self.found: list[DataFrame] = []

    def _run(self, rows: DataFrame) -> DataFrame:
        """A run of rows (fp, n) that are dealt by fp into the index's buckets already."""
        return sorted_table(rows.sortWithinPartitions("fp"), "run", "fp", self.buckets)

    def append(self, docs: DataFrame) -> DataFrame:
        return self.append_counts(window_counts(docs, self.size))

    def append_counts(self, counts: DataFrame) -> DataFrame:
        """append() of what window_counts() gives for a batch."""
        run = self._run(counts.select("fp", "n").repartition(self.buckets, "fp").groupBy("fp").agg(F.sum("n").alias("n")))
        found = run.filter("n > 1").select("fp")
        for old in self.runs:
            found = found.unionByName(run.select("fp").hint("merge").join(old.select("fp"), "fp"))
        found = stored(found, "found")
        self.runs.append(run)
        self.found.append(found)
        if len(self.runs) > self.most_runs:
            self.compact()
        return found.distinct()

    def compact(self) -> None:
        """All runs into one, by merges of two."""
        while len(self.runs) > 1:
            a, b = self.runs[:2]
            both = a.hint("merge").join(b.withColumnRenamed("n", "m"), "fp", "full")
            self.runs[:2] = [self._run(both.select("fp", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n")))]
            for run in (a, b):
                dropped_table(run)

    def repeated(self) -> DataFrame:
        """fp, once each: what append() has returned so far."""
        return reduce(DataFrame.unionByName, self.found).distinct()

    def drop(self) -> None:
        for run in self.runs:
            dropped_table(run)
        for found in self.found:
            dropped(found)
        self.runs, self.found = [], []


def row_key() -> Column:
    """Names a row by its id and whole text, so that repeated rows share a name and a fate."""
    return F.xxhash64("doc_id", "text").alias("key")


def of_documents(docs: DataFrame, repeated: DataFrame, size: int) -> DataFrame:
    """docs (key, text) with fps, the repeated fingerprints of each text, for texts that have some.

    The texts' fingerprints are joined with the repeated ones and gathered by text; a text's list is shorter than the text.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column("key").to_numpy()
            for at, _, buf, offs in chunked(b.column("text")):
                starts, ends, first = words.spans(buf, offs)
                w, fp, _ = fingerprints(words.hashes(buf, starts, ends), first, size)
                of = key[at + np.searchsorted(first, w, "right") - 1]
                new = np.concatenate([[True], (fp[1:] != fp[:-1]) | (of[1:] != of[:-1])]) if len(fp) else np.empty(0, bool)
                yield pa.RecordBatch.from_arrays([pa.array(of[new]), pa.array(fp[new].view(np.int64))], ["key", "fp"])

    own = stored(docs.mapInArrow(each, "key bigint, fp bigint"), "postings")
    lists = stored(own.join(repeated, "fp").groupBy("key").agg(F.collect_set("fp").alias("fps")), "lists")
    dropped(own)
    return docs.join(lists, "key")


def repeated_windows(docs: DataFrame, index: FingerprintIndex) -> DataFrame:
    """key, n_bytes, starts array<int>: the words at which windows start that occur at least twice in docs.

    docs (key, text) must have been appended to the index. Windows are counted by partial sums; the join back on their
    hashes is a plain sort-merge join of two stored tables, which adaptive execution splits where one passage is hot.
    """
    spark, size = docs.sparkSession, index.size
    repeated = stored(index.repeated(), "repeated")
    rows = repeated.count()
    if rows <= MOST_SHIPPED:
        shipped = spark.sparkContext.broadcast(bitmap_of(repeated, F.col("fp"), rows))
        docs = docs.select("key", "text", F.lit(None).cast("array<bigint>").alias("fps"))
    else:
        shipped = None
        docs = of_documents(docs, repeated, size).select("key", "text", "fps")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, fps = b.column("key").to_numpy(), b.column("fps")
            for at, end, buf, offs in chunked(b.column("text")):
                starts, ends, first = words.spans(buf, offs)
                h = words.hashes(buf, starts, ends)
                w, fp, _ = fingerprints(h, first, size)
                hit = shipped.value.has(fp) if shipped else np.isin(fp, fps.slice(at, end - at).flatten().to_numpy().view(np.uint64))
                w = w[hit]
                if not len(w):
                    continue
                text = np.searchsorted(first, w, "right") - 1
                one, two = words.windows(h, size)[w], words.windows(h, size, seed=2)[w]
                place = (np.diff(offs)[text] << 32) | (w - first[text])
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array((two >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(key[at + text]), pa.array(place)], ["w", "v", "key", "place"])

    found = stored(docs.mapInArrow(windows, "w bigint, v int, key bigint, place bigint"), "windows")
    twice = stored(found.groupBy("w", "v").agg(F.count("*").alias("n")).filter("n > 1").select("w", "v"), "twice")
    parts = found.join(twice, ["w", "v"]).select("key", F.shiftright("place", 32).cast("int").alias("n_bytes"), F.col("place").bitwiseAND((1 << 32) - 1).cast("int").alias("start"))
    out = stored(parts.groupBy("key", "n_bytes").agg(F.collect_set("start").alias("starts")), "starts")
    for t in (repeated, found, twice):
        dropped(t)
    return out


def without_repeats(docs: DataFrame, size: int = WINDOW, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (the kept words joined by one space), removed array<struct<start, end>> (word
    spans, end exclusive) for every row and whole text.

    A word goes if a window of `size` words covers it that starts anywhere else too, in the same text or another; windows
    are judged on the input, and all copies lose it. Null text: no words. Repeated rows repeat each other, so both lose
    what is long enough; null doc_ids are rows like others; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    whole_texts(spark)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", row_key())
    counts = stored(window_counts(docs, size, F.pmod("key", F.lit(batches))), "counts")
    index = FingerprintIndex(size, buckets=max(LEAST_BUCKETS, 1 << (counts.count() // (batches * BUCKET_ROWS)).bit_length()))
    for i in range(batches):
        index.append_counts(counts.filter(F.col("batch") == i))
    dropped(counts)
    starts = repeated_windows(docs.select("key", "text"), index)
    index.drop()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for b in batches:
            n_words, n_removed, kept, removed = [], [], [], []
            for text, begins in zip(b.column("text"), b.column("starts"), strict=True):
                own = text.as_buffer().to_pybytes().split()
                n, gone, spans = len(own), 0, []
                if begins.is_valid:
                    at = np.sort(begins.values.to_numpy())
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + size, -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    gone = n - int(stay.sum())
                    flips = np.flatnonzero(np.diff(np.concatenate([[True], stay, [True]]).astype(np.int8)))
                    spans = [{"start": int(a), "end": int(z)} for a, z in zip(flips[0::2], flips[1::2], strict=True)]
                    own = compress(own, stay.tolist())
                n_words.append(n)
                n_removed.append(gone)
                kept.append(b" ".join(own).decode())
                removed.append(spans)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(removed, pa.list_(pair))], ["doc_id", "n_words", "n_removed", "kept_text", "removed"])

    both = docs.withColumn("n_bytes", F.octet_length("text")).join(starts, ["key", "n_bytes"], "left").select("doc_id", "text", "starts")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(cut, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_text string, removed array<struct<start: bigint, end: bigint>>")


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op7_substring_dedup": op7_substring_dedup}
SQL = {
    "op7_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        x AS (SELECT doc_id, i, array_to_string(w[i:i+34], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35)),
        twice AS (SELECT s FROM x GROUP BY s HAVING count(*) > 1),
        gone AS (SELECT doc_id, list(DISTINCT p) AS p FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM x SEMI JOIN twice USING (s)) GROUP BY 1),
        kept AS (SELECT doc_id, len(w) AS n, coalesce(len(p), 0) AS r, CASE WHEN p IS NULL THEN w ELSE list_filter(w, lambda y, k: NOT list_contains(p, k)) END AS w FROM w LEFT JOIN gone USING (doc_id))
        SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(array_to_string(w, ' ')) AS kept_sha256 FROM kept
    """
}
