"""Sources: corpus folders, JSON and JSONL files, tolerant event logs, templates and strict configurations."""

from __future__ import annotations

import dataclasses
import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumenweir.functions.strict_json import parsed


def corpus_files(spark: SparkSession, path: str, glob: str = "*.sol", default_origin: str = "pool") -> DataFrame:
    """path, label (the file's folder), origin (the name's suffix after `__`, else a default), content: files in order of path.

    content is null where the bytes are no UTF-8, so that such files can be excluded with a reason.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.regexp_extract(name, r"__([A-Za-z0-9]+)\.[^.]+$", 1)
    return files.select("path", F.element_at(F.split("path", "/"), -2).alias("label"), F.coalesce(F.nullif(suffix, F.lit("")), F.lit(default_origin)).alias("origin"), F.try_validate_utf8(F.col("content").cast("string")).alias("content")).orderBy("path")


def named_files(spark: SparkSession, path: str, pattern: str, parts: list[str]) -> DataFrame:
    """path, content and the pattern's groups by name; a file name that doesn't match stops the read with an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    checked = F.when(name.rlike(f"^(?:{pattern})$"), name).otherwise(F.raise_error(F.concat(F.lit("unexpected file name: "), name)))
    return files.select("path", checked.alias("name"), F.col("content").cast("string").alias("content")).select("path", "content", *(F.regexp_extract("name", f"^(?:{pattern})$", i + 1).alias(p) for i, p in enumerate(parts)))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of a JSONL file or folder under a stated schema; blank lines are skipped, a missing file is an empty table."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def json_document(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def whole_text(spark: SparkSession, path: str) -> str | None:
    """The text of one small file, such as a published schema; null if it is missing."""
    return spark.read.text(path, wholetext=True).first()[0] if _exists(spark, path) else None


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """raw, event (variant) of each line that is JSON; other lines are skipped."""
    lines = spark.read.text(path).select(F.col("value").alias("raw"))
    return lines.withColumn("event", parsed(F.col("raw"))).filter("event IS NOT NULL")


def event_usage(log: DataFrame, keys: list[str], plain: tuple[str, ...] = ("agent_message", "reasoning")) -> DataFrame:
    """One row: the sum of each usage key over finished turns (null if none has it), other item types in order, errors."""
    get = lambda p, kind="string": F.try_variant_get("event", p, kind)
    kind, item = F.coalesce(get("$.type"), F.lit("")), F.coalesce(get("$.item.type"), F.lit("unknown"))
    of_item = kind.startswith("item.")
    tool = F.when(of_item & ~item.isin("error", *plain), item)
    failed = kind.isin("turn.failed", "error")
    error = F.when(of_item & (item == "error"), F.coalesce(get("$.item.message"), F.lit("error"))).when(failed, F.coalesce(get("$.error.message"), get("$.error"), get("$.message"), kind))
    whole = lambda k: F.when((kind == "turn.completed") & F.schema_of_variant(F.try_variant_get("event", f"$.usage.{k}", "variant")).rlike("INT$"), get(f"$.usage.{k}", "bigint"))
    return log.agg(*(F.sum(whole(k)).alias(k) for k in keys), F.array_sort(F.collect_set(tool)).alias("tools"), F.array_sort(F.collect_list(error)).alias("errors"))


def template(path: str, marker: str) -> str:
    """A prompt template, which must hold its marker exactly once."""
    text = Path(path).read_text(encoding="utf-8")
    if text.count(marker) != 1:
        raise ValueError(f"{path} must hold {marker} exactly once")
    return text


def strict_config(kind: type, path: str, paths: tuple[str, ...] = ()) -> Any:
    """A dataclass from a JSON or YAML file: unknown or missing keys are errors, `paths` are resolved against the file's folder."""
    at = Path(path)
    text = at.read_text(encoding="utf-8")
    if at.suffix in (".yaml", ".yml"):
        import yaml  # optional; JSON configurations need nothing

        data = yaml.safe_load(text)
    else:
        data = json.loads(text)
    fields = {f.name for f in dataclasses.fields(kind)}
    need = {f.name for f in dataclasses.fields(kind) if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING}
    if not isinstance(data, dict) or set(data) - fields or need - set(data):
        raise ValueError(f"{path}: unknown {sorted(set(data) - fields)}, missing {sorted(need - set(data))}")
    return kind(**{k: str((at.parent / v).resolve()) if k in paths else v for k, v in data.items()})
