"""Shared plumbing of the training-data operators: tables in the cluster's shared folder and whole-text batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweir.sources.tables import CLEANUP, dropped, shared_dir, stored  # noqa: F401

#: Rows of an Arrow batch of texts. Spark's default of 10,000 rows would put ten thousand long documents in one batch.
BATCH_ROWS = 500
#: Text bytes that the vectorised kernels take at once; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 18


def whole_texts(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small enough for a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for what runs inside; the session's own setting comes back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sorted_table(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Write df into the shared folder as a table bucketed and sorted by key, and return a scan of it: two such tables of as
    many buckets are merge-joined on the key without a shuffle."""
    spark = df.sparkSession
    called = f"lumenweir_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/lumenweir/{called}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.bucketBy(buckets, key).sortBy(key).option("compression", "zstd").option("path", path).saveAsTable(called)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.table(called)
    out._lumenweir_path, out._lumenweir_table = path, called
    return out


def dropped_table(df: DataFrame) -> None:
    """Delete a table made by sorted_table()."""
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._lumenweir_table}")
    dropped(df)


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and the whole text (null: empty), and further columns by name; all other columns are pruned at the scan."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column without nulls, and the n + 1 offsets of its texts in them; no copy is made."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def chunked(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of whole texts of about `most` bytes: (first row, end row, bytes, offsets)."""
    buf, offs = text_buffers(column)
    n, at = len(column), 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        end = min(end, n)
        yield at, end, buf[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end
