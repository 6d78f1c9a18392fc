"""Retry loops: as state over a stream of attempts, and as rounds of calls that continue a run of the same identity only."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumenweir.operators import attempts as A
from lumenweir.operators.manifest import settings_key
from lumenweir.sources.tables import dropped, shared_dir, stored

EPISODE = "query_id bigint, first_event bigint, last_event bigint, attempts bigint, outcome string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Retries(StatefulProcessor):
    """Attempts of one key: an episode ends with a status other than invalid, with the last attempt allowed, or given up after
    a time without an attempt. A key has state only while an episode of it is open."""

    def __init__(self, most_attempts: int, give_up_ms: int) -> None:
        self.most, self.wait = most_attempts, give_up_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "attempts bigint, first bigint, last bigint, ms bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        have = tuple(self.open.get()) if self.open.exists() else None
        timer = have[3] if have else None
        for event, ms, status in sorted((r.event_id, r.ms, r.status) for r in rows):
            if have and ms - have[3] > self.wait:
                yield self._row(key, have, "gave_up")
                have = None
            have = (have[0] + 1 if have else 1, have[1] if have else event, event, ms)
            if status != "invalid" or have[0] >= self.most:
                yield self._row(key, have, status if status != "invalid" else "exhausted")
                have = None
        if timer is not None:
            self.handle.deleteTimer(timer + self.wait + 1)
        if have:
            self.open.update(have)
            self.handle.registerTimer(have[3] + self.wait + 1)
        elif timer is not None:
            self.open.clear()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.open.exists():
            yield self._row(key, tuple(self.open.get()), "gave_up")
            self.open.clear()

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key: tuple, have: tuple, outcome: str) -> Row:
        return Row(query_id=key[0], first_event=have[1], last_event=have[2], attempts=have[0], outcome=outcome)


def episodes(records: DataFrame, most_attempts: int, give_up: timedelta, late: str = "0 seconds") -> DataFrame:
    """query_id, first_event, last_event, attempts, outcome of each ended episode of a stream (query_id, event_id, ts timestamp, status).

    outcome: the status that ended it, `exhausted`, or `gave_up` once the watermark has passed the last attempt by `give_up`,
    or the next attempt comes later than that. Records later than the watermark's delay are dropped, and so
    are those without a key. Attempts are taken in order of event_id.
    """
    wait = int(give_up.total_seconds() * 1000)
    rows = records.filter(F.col("query_id").isNotNull()).withWatermark("ts", late)
    rows = rows.select("query_id", "event_id", "ts", "status", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("query_id").transformWithState(Retries(most_attempts, wait), EPISODE, "append", "EventTime")


def replayed_episodes(log: DataFrame, most_attempts: int, give_up: timedelta, slices: int = 4) -> tuple[DataFrame, list[dict]]:
    """Episodes of a log (query_id, event_id, ts, status) that is replayed as a stream of so many slices by time, and for each
    batch the rows that came in and the rows of state that were left."""
    spark = log.sparkSession
    at = f"{shared_dir(spark)}/lumenweir/retry-{uuid.uuid4().hex}"
    log = stored(log.withColumn("ts", F.col("ts").cast("timestamp")), "retry_log")
    cuts = log.select(F.unix_millis("ts").alias("ms")).approxQuantile("ms", [i / slices for i in range(1, slices)], 0.01)
    ms = F.unix_millis("ts")
    for lower, upper in zip([None, *cuts], [*cuts, None], strict=True):
        inside = (F.lit(True) if lower is None else ms >= int(lower)) & (F.lit(True) if upper is None else ms < int(upper))
        log.filter(inside).coalesce(1).write.mode("append").parquet(f"{at}/log")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/log")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/episodes/batch={number}")  # a batch that is done again replaces itself

    with setting(spark, PROVIDER, ROCKS):
        query = episodes(stream, most_attempts, give_up).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        progress = [{"rows": p["numInputRows"], "state": sum(s["numRowsTotal"] for s in p["stateOperators"])} for p in query.recentProgress]
    dropped(log)
    return spark.read.schema(f"{EPISODE}, batch int").parquet(f"{at}/episodes").drop("batch"), progress


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def claim(spark: SparkSession, folder: str, settings: dict, inputs: DataFrame) -> str:
    """The key of a run's settings and input rows, written into a new folder; a folder of another run is an error.

    The inputs' key is a sum of row hashes, so that it doesn't depend on their order.
    """
    rows = inputs.select(F.xxhash64(F.to_json(F.struct(*inputs.columns))).cast("decimal(38,0)").alias("h"))
    found = rows.agg(F.count("*").alias("n"), F.sum("h").alias("h")).first()
    key = settings_key(settings | {"rows": found.n, "inputs": str(found.h)})
    if exists(spark, f"{folder}/run"):
        have = spark.read.parquet(f"{folder}/run").first()["run_key"]
        if have != key:
            raise ValueError(f"{folder} belongs to another run: {have} is not {key}")
    else:
        spark.createDataFrame([(key,)], "run_key string").write.parquet(f"{folder}/run")
    return key


CALLS = "query_id {kind}, attempt bigint, status string, usable boolean"


def retry_rounds(keys: DataFrame, call: Callable[[DataFrame], DataFrame], folder: str, settings: dict, most_attempts: int, most_calls: int | None = None) -> tuple[DataFrame, str]:
    """Call for all keys without a terminal record, round by round; (the log of calls, why it ended: complete, capped or stopped).

    call takes rows (query_id, next_attempt and the columns of keys) and returns query_id, attempt, status (a terminal one,
    or invalid) and usable: false for a call that was refused, which uses up no attempt and stops the run after its round. At
    most `most_calls` are made, by query_id. A round is one job, and its log a folder of its own: a run that was cut off in
    a round makes that round again; one that goes on in its folder must have the same settings and keys.
    """
    spark = keys.sparkSession
    claim(spark, folder, settings | {"most_attempts": most_attempts}, keys)
    kind = keys.schema["query_id"].dataType.simpleString()
    schema = CALLS.format(kind=kind) + ", round int"
    none = spark.createDataFrame([], schema)
    read = lambda n: spark.read.schema(schema).option("basePath", f"{folder}/calls").parquet(*(f"{folder}/calls/round={i}" for i in range(n))) if n else none
    rounds = 0
    while exists(spark, f"{folder}/calls/round={rounds}/_SUCCESS"):
        rounds += 1
    spent = 0
    while True:
        log = read(rounds)
        todo = A.pending(keys, log.filter("usable").select("query_id", "attempt", "status"), "query_id", "attempt", most_attempts)
        if most_calls is not None:
            todo = A.capped(todo, most_calls - spent, "query_id")
        if todo.isEmpty():
            done = most_calls is None or spent < most_calls
            return log, "complete" if done else "capped"
        call(todo).select("query_id", "attempt", "status", "usable").write.mode("overwrite").parquet(f"{folder}/calls/round={rounds}")
        rounds += 1
        made = read(rounds).filter(F.col("round") == rounds - 1).agg(F.count("*").alias("n"), F.coalesce(F.bool_and("usable"), F.lit(True)).alias("usable")).first()
        spent += made.n
        if not made.usable:
            return read(rounds), "stopped"


def hashed_calls(status: Column, refused: Column | None = None) -> Callable[[DataFrame], DataFrame]:
    """A stand-in for calls whose answers follow from query_id and next_attempt."""

    def call(todo: DataFrame) -> DataFrame:
        usable = ~refused if refused is not None else F.lit(True)
        return todo.select("query_id", F.col("next_attempt").cast("bigint").alias("attempt"), status.alias("status"), usable.alias("usable"))

    return call
