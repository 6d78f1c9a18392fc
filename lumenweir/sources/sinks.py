"""Sinks: partitioned Parquet, canonical JSONL, documents, append-only logs, atomic publishing and reports."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweir.functions.text import number_text
from lumenweir.operators.manifest import verified


def parquet_by(df: DataFrame, path: str, *by: str) -> None:
    """Parquet files by partition or mode."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def canonical_lines(df: DataFrame) -> DataFrame:
    """One JSON text a row: keys in order, nulls kept, other characters as they are."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def jsonl(df: DataFrame, path: str) -> None:
    canonical_lines(df).write.mode("overwrite").text(path)


def jsonl_by(df: DataFrame, path: str, by: str) -> None:
    """JSONL files by the values of a column, which also stays in the rows."""
    lines = df.select(F.col(by).alias("_by"), F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))
    lines.withColumnRenamed("_by", f"by_{by}").write.mode("overwrite").partitionBy(f"by_{by}").text(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append rows to a JSON log."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def texts(df: DataFrame, column: str, path: str) -> None:
    """The texts of a column, one file for each task, for a dry run."""
    df.select(F.col(column).alias("value")).write.mode("overwrite").option("lineSep", "\n\x1e\n").text(path)


def document(value: Any, path: str) -> None:
    """A small JSON document with sorted keys and a last line end."""
    Path(path).write_text(json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n", encoding="utf-8")


def publish(path: str, write: Callable[[str], None]) -> None:
    """Write a folder as a whole: it is staged beside its place and then takes it, so readers see the old or the new one."""
    at = Path(path)
    at.parent.mkdir(parents=True, exist_ok=True)
    stage = tempfile.mkdtemp(prefix=f".{at.name}-", dir=at.parent)
    try:
        write(stage)
        old = Path(f"{stage}.old")
        if at.exists():
            os.replace(at, old)
        os.replace(stage, at)
        shutil.rmtree(old, ignore_errors=True)
    finally:
        shutil.rmtree(stage, ignore_errors=True)


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def commit_version(spark: SparkSession, folder: str, tables: dict[str, DataFrame]) -> str:
    """Publish tables as one new version of a folder on any file system that Spark writes to, and return its name.

    The tables go into a folder of the version's own, with a manifest of the digests of their files; then a pointer is replaced by one
    atomic rename. A reader sees the version before or this one whole, whatever fails on the way; old versions stay readable.
    """
    name = f"v-{uuid.uuid4().hex}"
    for table, df in tables.items():
        df.write.parquet(f"{folder}/{name}/{table}")
    _digests(spark, f"{folder}/{name}", list(tables)).write.parquet(f"{folder}/{name}/_manifest")
    jvm, pointer, fs = _hadoop(spark, f"{folder}/current")
    _, fresh, _ = _hadoop(spark, f"{folder}/.current-{name}")
    out = fs.create(fresh)
    out.write(bytearray(name.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    kind = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    how = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    how[0] = jvm.java.lang.Enum.valueOf(kind, "OVERWRITE")
    context.rename(fs.makeQualified(fresh), fs.makeQualified(pointer), how)
    return name


def _digests(spark: SparkSession, version: str, tables: list[str]) -> DataFrame:
    """name (table/file), sha256 of the Parquet files of a version."""
    files = [spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{version}/{t}").select(F.lit(t).alias("t"), "path", "content") for t in tables]
    every = reduce(DataFrame.unionByName, files)
    return every.select(F.concat("t", F.lit("/"), F.element_at(F.split("path", "/"), -1)).alias("name"), F.sha2("content", 256).alias("sha256"))


def current_version(spark: SparkSession, folder: str) -> str:
    """The name of the version that the pointer names."""
    _, pointer, fs = _hadoop(spark, f"{folder}/current")
    if not fs.exists(pointer):
        raise FileNotFoundError(f"nothing is published in {folder}")
    return spark.read.text(f"{folder}/current").first()[0]


def read_version(spark: SparkSession, folder: str, table: str, version: str | None = None, check: bool = True) -> DataFrame:
    """A table of the current version, or of one that was; its files are held against the manifest first, unless check is off."""
    at = f"{folder}/{version or current_version(spark, folder)}"
    if check:
        stated = spark.read.parquet(f"{at}/_manifest").filter(F.startswith("name", F.lit(f"{table}/")))
        bad = verified(stated, _digests(spark, at, [table])).filter("state <> 'ok'").orderBy("name").limit(3).collect()
        if bad:
            raise ValueError(f"{at}: " + ", ".join(f"{r['name']} is {r['state']}" for r in bad))
    return spark.read.parquet(f"{at}/{table}")


def copy_manifest(spark: SparkSession, folder: str, to: str) -> None:
    """The manifest of the current version as one JSON lines file in a folder `to`, in order of names, to keep beside the code."""
    manifest = spark.read.parquet(f"{folder}/{current_version(spark, folder)}/_manifest")
    manifest.orderBy("name").coalesce(1).write.mode("overwrite").json(to)


def markdown(scores: DataFrame, columns: list[str], title: str) -> str:
    """A Markdown table of a small result (one row a mode): numbers to three digits, an em dash for null."""
    kinds = dict(scores.dtypes)
    cells = [number_text(F.col(c)) if kinds[c] == "double" else F.coalesce(F.col(c).cast("string"), F.lit("—")) for c in columns]
    rows = scores.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line")).orderBy("line").collect()
    return "\n".join([f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *(r.line for r in rows)]) + "\n"
