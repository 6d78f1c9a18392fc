"""Quality classifier by hierarchical empirical Bayes: each document's own evidence, shrunk towards its path and host.

A document's evidence is a calibrated log-odds of being good, from hashed n-grams of its text, repeated words and length.
Hosts and paths get the mean evidence of their documents, shrunk towards the level above by a strength estimated from the
spread between hosts (or between paths); a document's posterior combines its evidence with its path's rate without itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweir.llm.common import chunked, documents, stored, whole_texts
from lumenweir.llm.quality import base_counts, count_grams, log_ratio, mean_of

#: Labelled documents that the classifier is fitted on, at most: those with the least hashes of their ids.
MOST_LABELLED = 20_000
#: Bounds of a strength, in documents.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1000.0


def features(ratio: np.ndarray, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Per text: mean n-gram log ratio, share of repeated words, and whether it has fewer than 50 words."""
    base = base_counts(buf, offs)
    n = base["n_words"]
    return np.stack([mean_of(ratio, buf, offs), base["n_repeat_words"] / np.maximum(n, 1), n < 50], axis=1).astype(float)


def feature_column(spark, ratio: np.ndarray) -> Column:
    shipped = spark.sparkContext.broadcast(ratio)

    def get(text: pa.Array) -> pa.Array:
        text = text.fill_null("")
        out = np.zeros((len(text), 3))
        for at, end, buf, offs in chunked(text):
            out[at:end] = features(shipped.value, buf, offs)
        return pa.StructArray.from_arrays([pa.array(out[:, k]) for k in range(3)], ["ratio", "repeats", "short"])

    return F.arrow_udf(get, "struct<ratio: double, repeats: double, short: double>").asNondeterministic()(F.col("text"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the first coefficient is the intercept."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """(n-gram table, coefficients, share of good documents) from a bounded sample of labelled documents.

    One half of the sample gives the n-gram table, the other calibrates it. Without both labels the evidence is 0.
    """
    spark = docs.sparkSession
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("good"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED)
    own = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    half = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(2))
    good, bad = count_grams(own.filter(half == 0), [F.col("good") == 1, F.col("good") == 0])
    ratio = log_ratio(good, bad)
    rows = own.filter(half == 1).select("good", feature_column(spark, ratio).alias("f")).select("good", "f.*").toArrow()
    y = rows["good"].to_numpy().astype(float)
    if len(y) == 0 or y.min() == y.max():
        return ratio, np.zeros(4), 0.5
    x = np.stack([rows[k].to_numpy() for k in ("ratio", "repeats", "short")], axis=1)
    return ratio, logistic(x, y), float(np.clip(y.mean(), 0.01, 0.99))


def strength(groups: DataFrame, mean: Column) -> float:
    """How many documents a group's mean must count against its parent's, by the method of moments.

    groups (n, s, q): documents, sum and sum of squares of their evidence. mean: the parent's rate, of each group.
    """
    g = groups.withColumn("rate", F.col("s") / F.col("n")).withColumn("parent", mean)
    within = F.sum((F.col("q") - F.col("n") * F.pow(F.col("rate"), 2))) / F.greatest(F.sum(F.col("n") - 1), F.lit(1))
    between = F.sum(F.col("n") * F.pow(F.col("rate") - F.col("parent"), 2)) / F.sum("n")
    noise = F.count("*") / F.sum("n")
    w, b, m = g.agg(within, between, noise).first()
    if w is None:  # no groups at all
        return LEAST_STRENGTH
    return min(max(w / max(b - w * m, 1e-12), LEAST_STRENGTH), MOST_STRENGTH)


def log_odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.ln(p / (1 - p))


def site_quality(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None) -> DataFrame:
    """doc_id, host, path, evidence, host_rate, path_rate, posterior, kept: one row for each row of docs.

    Evidence takes one pass over all whole texts without a shuffle; sums by path, then host, are partial aggregates of a few
    numbers, and the rates join back by path, split where a site is hot. host defaults to `source`, path to `source` and
    `lang`. Null text: empty. A null host or path is a site of its own. Null doc_ids stay; repeated rows each count and get
    a row; ties at one half are kept; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    whole_texts(spark)
    host = F.col("source") if host is None else host
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))) if path is None else path
    ratio, w, base = fitted(docs, labels)
    f = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), host), F.lit("null")).alias("host"), F.coalesce(F.concat(F.lit("="), path), F.lit("null")).alias("path"), feature_column(spark, ratio).alias("f"))
    evidence = F.lit(float(w[0])) + sum(F.lit(float(c)) * F.col(f"f.{k}") for c, k in zip(w[1:], ("ratio", "repeats", "short"), strict=True))
    rows = stored(f.select("doc_id", "host", "path", F.least(F.greatest(evidence, F.lit(-30.0)), F.lit(30.0)).alias("evidence")).withColumn("p", 1 / (1 + F.exp(-F.col("evidence")))), "evidence")
    sums = (F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q"))
    paths = stored(rows.groupBy("host", "path").agg(*sums), "paths")
    hosts = stored(paths.groupBy("host").agg(*(F.sum(k).alias(k) for k in "nsq")), "sites")
    every = F.lit(hosts.agg(F.try_divide(F.sum("s"), F.sum("n"))).first()[0] or 0.5)
    kh = F.lit(strength(hosts, every))
    hosts = stored(hosts.select("host", ((F.col("s") + kh * every) / (F.col("n") + kh)).alias("host_rate")), "hosts")
    rated = stored(paths.join(hosts, "host"), "rated")
    kp = F.lit(strength(rated, F.col("host_rate")))
    out = rows.join(rated, ["host", "path"])
    others = (F.col("s") - F.col("p") + kp * F.col("host_rate")) / (F.col("n") - 1 + kp)
    out = out.withColumn("path_rate", others).withColumn("posterior", 1 / (1 + F.exp(-(F.col("evidence") - F.lit(float(np.log(base / (1 - base)))) + log_odds(F.col("path_rate"))))))
    return out.select("doc_id", "host", "path", "evidence", "host_rate", "path_rate", "posterior", (F.col("posterior") >= 0.5).alias("kept"))


def op10_site_quality(spark, sf_dir: str) -> DataFrame:
    return site_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op10_site_quality": op10_site_quality}
SQL: dict[str, str] = {}
