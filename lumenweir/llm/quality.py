"""Quality rules: base counts of each document, and a hashed n-gram log-likelihood ratio against a trusted target.

N-grams are runs of NGRAM bytes, hashed into BUCKETS buckets. Two multinomials are counted over whole texts: the trusted
target (documents labelled good) and the raw corpus (all documents). A document's score is the mean over its n-grams of
log p_target - log p_raw, so it doesn't depend on length; a fixed threshold decides on every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweir.llm import words
from lumenweir.llm.common import chunked, documents, dropped, stored, whole_texts

NGRAM = 4
BUCKETS = 1 << 16
#: Mean log-likelihood ratio per n-gram below which a document is rejected.
THRESHOLD = -0.6
MIN_WORDS = 50
#: Ids of trusted documents that are broadcast, at most, as one sorted array of 8 bytes each, so that no text is moved for
#: the fit. More are joined, which moves texts but counts the same: both multinomials count every document of theirs.
MOST_SHIPPED = 8_000_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def grams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram at each byte but the last few, and the sizes of the texts in n-grams.

    N-grams over a text boundary are moved out by a mask, so that the buckets of one text lie together.
    """
    n = len(buf) - NGRAM + 1
    sizes = np.maximum(np.diff(offs) - NGRAM + 1, 0)
    if n <= 0:
        return np.empty(0, np.uint32), sizes
    code = buf[:n].astype(np.uint32)
    for j in range(1, NGRAM):
        code |= buf[j : j + n].astype(np.uint32) << np.uint32(8 * j)
    code = (code * np.uint32(2654435761)) >> np.uint32(16)
    whole = np.ones(n, bool)
    for j in range(1, NGRAM):
        cut = offs[1:] - j
        whole[cut[(cut >= 0) & (cut < n)]] = False
    short = np.flatnonzero(np.diff(offs) < NGRAM)
    for i in short:  # marks of a short text may fall into the text before it, where they are right anyhow
        whole[offs[i] : offs[i + 1]] = False
    return code[whole], sizes


def repeated_words(word_hashes: np.ndarray, first: np.ndarray, size: int = 3) -> np.ndarray:
    """Per text, the words inside windows of `size` words that occur twice or more in it (64-bit hashes of the windows)."""
    covered = np.zeros(len(word_hashes) + size, bool)
    at = words.inside_text(first, size)
    if len(at):
        owner = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))[at]
        key = words.windows(word_hashes, size)[at] ^ words.mixed(owner + np.uint64(1))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for j in range(size):
            covered[at[twice] + j] = True
    return words.per_text(covered[: len(word_hashes)], first)


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def base_counts(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    starts, ends, first = words.spans(buf, offs)
    raw = buf.tobytes()
    chars = ~words._SPACE[buf] & ((buf & 0xC0) != 0x80)
    return {
        "n_words": np.diff(first),
        "word_chars": words.per_text(chars, offs),
        "n_symbols": words.per_text(_SYMBOL[buf], offs),
        "n_dup_lines": np.array([duplicate_lines(raw[a:b]) for a, b in zip(offs[:-1], offs[1:], strict=True)], np.int64),
        "n_repeat_words": repeated_words(words.hashes(buf, starts, ends), first),
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def count_grams(docs: DataFrame, classes: list[Column]) -> np.ndarray:
    """Counts (class, bucket) of the n-grams of the rows of each class, over all rows and whole texts.

    Each task counts into one fixed array and emits at most BUCKETS rows; the sums are as large whatever the corpus.
    """
    spark = docs.sparkSession
    whole_texts(spark)
    k = len(classes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, BUCKETS), np.int64)
        for b in batches:
            flags = [np.asarray(b.column(f"c{i}").to_numpy(zero_copy_only=False), bool) for i in range(k)]
            for at, end, buf, offs in chunked(b.column("text")):
                code, sizes = grams(buf, offs)
                for i in range(k):
                    own = flags[i][at:end]
                    part = code if own.all() else code[np.repeat(own, sizes)]
                    total[i] += np.bincount(part, minlength=BUCKETS)
        some = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(total[i][some]) for i in range(k))], ["bucket", *(f"n{i}" for i in range(k))])

    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), *(F.coalesce(c, F.lit(False)).alias(f"c{i}") for i, c in enumerate(classes)))
    parts = rows.mapInArrow(count, "bucket int, " + ", ".join(f"n{i} bigint" for i in range(k)))
    out = np.zeros((k, BUCKETS))
    for r in parts.groupBy("bucket").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(k))).collect():
        out[:, r[0]] = r[1:]
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw of each bucket; 0 everywhere if either side has no text.

    Both counts are brought to the smaller side's total before one is added to each, so that a bucket that the smaller
    side is too small to have seen says nothing.
    """
    least = min(target.sum(), raw.sum())
    if not least:
        return np.zeros(BUCKETS)
    return np.log(target * (least / target.sum()) + 1) - np.log(raw * (least / raw.sum()) + 1)


def mean_of(ratio: np.ndarray, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Mean of a bucket table over each text's n-grams; 0 for a text without any."""
    code, sizes = grams(buf, offs)
    ends = np.cumsum(sizes)
    sums = np.zeros(len(sizes))
    some = np.flatnonzero(sizes)
    if len(some):
        sums[some] = np.add.reduceat(ratio[code], (ends - sizes)[some])
    return sums / np.maximum(sizes, 1)


def with_trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, trusted of every row of docs; trusted documents have a label of quality 1."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    good = stored(good, "trusted")
    if good.count() > MOST_SHIPPED:
        return docs.join(good.withColumn("trusted", F.lit(True)).hint("merge"), "doc_id", "left")
    shipped = spark.sparkContext.broadcast(np.sort(good.toArrow()["doc_id"].to_numpy()))
    dropped(good)

    def trusted(doc_id: pa.Array) -> pa.Array:
        ids, have = shipped.value, doc_id.fill_null(0).to_numpy(zero_copy_only=False)
        if not len(ids):
            return pa.array(np.zeros(len(have), bool))
        same = ids[np.minimum(np.searchsorted(ids, have), len(ids) - 1)] == have
        return pa.array(same & doc_id.is_valid().to_numpy(zero_copy_only=False))

    return docs.withColumn("trusted", F.arrow_udf(trusted, "boolean")(F.col("doc_id").cast("bigint")))


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> Column:
    """A column for the rows of docs: struct of the base counts, base_failed, kept and score.

    Fitting reads every document once, against a broadcast of the ids of all trusted documents (a join beyond MOST_SHIPPED
    of them, which alone moves texts); the column then needs one more pass. The model is BUCKETS numbers whatever the corpus. Null text: no words, so
    base_failed. Null doc_ids and labels match nothing; repeated labels of a document count once; a document with any
    label of quality 1 is trusted. Without trusted text the score is 0 and the base rules decide alone. Repeated rows get
    the same verdict; other columns pass through untouched.
    """
    spark = docs.sparkSession
    whole_texts(spark)
    target, raw = count_grams(with_trusted(docs, labels), [F.col("trusted"), F.lit(True)])
    shipped = spark.sparkContext.broadcast(log_ratio(target, raw))

    def verdict(text: pa.Array) -> pa.Array:
        n = len(text)
        text = text.fill_null("")
        out = {k: np.zeros(n, np.int64) for k in COUNTS}
        score = np.zeros(n)
        for at, end, buf, offs in chunked(text):
            for k, v in base_counts(buf, offs).items():
                out[k][at:end] = v
            score[at:end] = mean_of(shipped.value, buf, offs)
        failed = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
        kept = ~failed & (score >= threshold)
        return pa.StructArray.from_arrays([*(pa.array(out[k]) for k in COUNTS), pa.array(failed), pa.array(kept), pa.array(score)], [*COUNTS, "base_failed", "kept", "score"])

    kind = "struct<" + ", ".join(f"{k}: bigint" for k in COUNTS) + ", base_failed: boolean, kept: boolean, score: double>"
    return F.arrow_udf(verdict, kind).asNondeterministic()(F.col("text"))


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    q = quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.select("doc_id", q.alias("q")).select("doc_id", "q.*")


QUERIES = {"op2_quality_rules": op2_quality_rules}
SQL: dict[str, str] = {}
