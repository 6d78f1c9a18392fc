"""The attempt log as a stream: records arrive as files, the latest state of each key and a running summary are kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweir.sources.tables import shared_dir


def latest_state(records: DataFrame, most_attempts: int) -> DataFrame:
    """query_id, event_id, status, attempts, terminal: a streaming (or batch) aggregate over append-only records."""
    last = F.max(F.struct("event_id", "status")).alias("r")
    out = records.groupBy("query_id").agg(last, F.count("*").alias("attempts"))
    return out.select("query_id", "r.event_id", "r.status", "attempts", ((F.col("r.status") != "invalid") | (F.col("attempts") >= most_attempts)).alias("terminal"))


def summary(records: DataFrame) -> DataFrame:
    """A running count by status, rewritten after each batch."""
    return records.groupBy("status").agg(F.count("*").alias("n"))


def run_available(stream: DataFrame, out: str, mode: str = "complete") -> None:
    """Process all that is there, batch by batch, into one Parquet folder; a rerun continues from the checkpoint."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/state")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def log_stream(spark: SparkSession, path: str, schema, files_each: int = 2) -> DataFrame:
    """An append-only JSON log as a stream of files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).json(path)


def replayed(log: DataFrame, most_attempts: int) -> DataFrame:
    """The state after streaming a log that is first written as JSON files in the shared folder; equal to the batch result."""
    spark = log.sparkSession
    at = f"{shared_dir(spark)}/lumenweir/stream-{uuid.uuid4().hex}"
    log.repartition(4, "query_id").write.json(f"{at}/log")
    run_available(latest_state(log_stream(spark, f"{at}/log", log.schema), most_attempts), at)
    return spark.read.parquet(f"{at}/state")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of attempts by key with a watermark: late records beyond it are dropped. ts may be without a zone (UTC)."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    return e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("attempts")).select("user_id", "w.start", "w.end", "attempts")
