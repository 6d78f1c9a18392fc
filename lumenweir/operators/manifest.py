"""Content-addressed manifests: digests of rows and files, and their verification."""

from __future__ import annotations

import hashlib
import json
import platform

import pyspark
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def content_manifest(rows: DataFrame, name: Column, value: Column) -> DataFrame:
    """name, n, sha256: a digest of the sorted digests of each name's values.

    The values' own digests are combined in two steps, so that no task sorts a whole name: by their first three characters,
    then over those 4096 parts.
    """
    each = rows.select(name.alias("name"), F.sha2(value, 256).alias("d")).withColumn("part", F.substring("d", 1, 3))
    parts = each.groupBy("name", "part").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("d"))
    return parts.groupBy("name").agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "d"))), lambda x: x["d"]), ""), 256).alias("sha256"))


def manifest_digest(manifest: DataFrame, leave_out: tuple[str, ...] = ()) -> DataFrame:
    """One digest of the canonical JSON {name: sha256} of a manifest in order of names."""
    pair = F.concat(F.lit('"'), F.col("name"), F.lit('":"'), F.col("sha256"), F.lit('"'))
    kept = manifest.filter(~F.col("name").isin(*leave_out)) if leave_out else manifest
    return kept.agg(F.sha2(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", pair.alias("p")))), lambda x: x["p"]), ","), F.lit("}")), 256).alias("digest"))


def verified(stated: DataFrame, found: DataFrame) -> DataFrame:
    """name, state (ok, changed, missing, unexpected): a full outer comparison of two manifests."""
    a, b = stated.select("name", F.col("sha256").alias("want")), found.select("name", F.col("sha256").alias("got"))
    state = F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("want") != F.col("got"), "changed").otherwise("ok")
    return a.join(b, "name", "full_outer").select("name", state.alias("state"))


def stale_rows(rows: DataFrame, payload: Column, stored: Column) -> DataFrame:
    """Rows whose payload no longer has the digest that was stored with them."""
    return rows.filter(~F.sha2(payload, 256).eqNullSafe(stored))


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """name, sha256 of the files of a folder."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """missing, unexpected: keys of left that right lacks, and the reverse; a full cover has 0 and 0."""
    a = left.select(key).distinct().withColumn("l", F.lit(True))
    b = right.select(key).distinct().withColumn("r", F.lit(True))
    return a.join(b, key, "full_outer").agg(F.count_if(F.col("r").isNull()).alias("missing"), F.count_if(F.col("l").isNull()).alias("unexpected"))


def settings_key(settings: dict) -> str:
    """Digest of settings as canonical JSON: a run with another key must not continue this one."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def environment(spark: SparkSession, inputs: DataFrame | None = None) -> dict:
    """Versions and the digests of input files (a file_manifest), for a provenance record."""
    return {
        "python": platform.python_version(),
        "pyspark": pyspark.__version__,
        "spark": spark.version,
        "inputs": {r["name"]: r["sha256"] for r in inputs.collect()} if inputs is not None else {},
    }
