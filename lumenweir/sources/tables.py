"""Tables: the driver's Parquet inputs, and intermediate tables in the folder that a cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's ``spark.checkpoint.dir``; a local one only if unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return at or "/tmp/lumenweir-checkpoints"


#: Delete an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and return a scan of it: lineage ends there and survives lost executors.

    The write's shuffle files go at its end; nothing reads them again, as readers scan the table. group_rows: the most rows of
    a row group, for rows of megabytes, as a writer first looks at its size after 100 rows and a reader takes thousands at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumenweir/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        write = df.write.option("compression", "zstd")
        (write.option("parquet.block.row.count.limit", group_rows) if group_rows else write).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._lumenweir_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by stored(), once nothing reads them any more."""
    path = getattr(df, "_lumenweir_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
