"""Runs in stages that survive a restart: a finished stage is read again, and no run continues another's."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweir.operators.manifest import settings_key
from lumenweir.sources.readers import whole_text
from lumenweir.sources.sinks import commit_version, read_version

#: Hex digits of one of the four sums of a multiset digest: 60 bits, so that 10^19 rows fit a decimal of 38 digits.
PIECE = 15


def multiset_digest(value: Column) -> Column:
    """An aggregate: SHA-256 of the number of values and of four sums over pieces of the values' SHA-256.

    The order of rows doesn't matter and repeated rows count, and nothing is sorted or shuffled but one row a task. It tells
    tables apart that differ by accident; it is no protection against someone who looks for two with one digest.
    """
    digest = F.coalesce(F.sha2(value, 256), F.lit("0" * 64))
    sums = [F.sum(F.conv(F.substring(digest, 1 + i * PIECE, PIECE), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *(F.coalesce(s, F.lit("0")) for s in sums)), 256)


def content_digest(df: DataFrame) -> str:
    """The digest of a table's rows, with the names and types of its columns in order of names."""
    row = F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns))), {"ignoreNullFields": "false"})
    kinds = ",".join(f"{name}:{kind}" for name, kind in sorted(df.dtypes))
    return df.select(row.alias("row")).agg(F.sha2(F.concat_ws("|", F.lit(kinds), multiset_digest(F.col("row"))), 256)).first()[0]


class OtherRun(ValueError):
    """The folder holds a run of other settings or inputs."""


class Stages:
    """The stages of one run in a folder. The run is what its settings and the rows of its inputs are: where the folder holds
    a run, both must be the same, or it is an error that names what differs. Settings must be JSON; a version of the code
    that changes results belongs among them.

    The run's record is created before its first stage by a call that fails where there is one, so that of two runs that start at once one
    stops. A stage's tables are published as a whole (see commit_version()), so one cut short is built anew.
    """

    def __init__(self, spark: SparkSession, folder: str, settings: dict, inputs: dict[str, DataFrame]):
        self.spark, self.folder, self.built, self.reused = spark, folder, [], []
        own = {"settings": json.loads(json.dumps(settings)), "inputs": {name: content_digest(df) for name, df in inputs.items()}}
        self.key = settings_key(own)
        record = f"{folder}/run.json"
        text = whole_text(spark, record)
        if text is None:
            self._create(record, json.dumps(own | {"key": self.key}, sort_keys=True))
            return
        stated = json.loads(text)
        if stated["key"] != self.key:
            differs = [f"{part}.{name}" for part in ("settings", "inputs") for name in sorted({*own[part], *stated[part]}) if own[part].get(name, ...) != stated[part].get(name, ...)]
            raise OtherRun(f"{folder} holds another run; these differ: {', '.join(differs)}")

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _create(self, path: str, text: str) -> None:
        at, fs = self._fs(path)
        out = fs.create(at, False)
        out.write(bytearray(text.encode()))
        out.close()

    def done(self, name: str) -> bool:
        at, fs = self._fs(f"{self.folder}/{name}/current")
        return fs.exists(at)

    def stage(self, name: str, build: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
        """The tables of a stage: read where it is done, their files held against its manifest, built and published where not.

        Its first publication also states which tables it has.
        """
        folder = f"{self.folder}/{name}"
        if not self.done(name):
            tables = build()
            names = self.spark.createDataFrame([(t,) for t in sorted(tables)], "name string")
            commit_version(self.spark, folder, {**tables, "_tables": names.coalesce(1)})
            self.built.append(name)
        else:
            self.reused.append(name)
        return {r["name"]: read_version(self.spark, folder, r["name"]) for r in read_version(self.spark, folder, "_tables").collect()}
