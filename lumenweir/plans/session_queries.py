"""Queries over sessions of calls, gates, orders of names and number formats."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweir.functions import identity as I

from lumenweir.functions import text as T
from lumenweir.operators import attempts as A
from lumenweir.operators import curation as C
from lumenweir.operators import metrics as M
from lumenweir.plans.corpus import LOG, ROWS, log, rows
from lumenweir.plans.metric_queries import f1_sql
from lumenweir.sources import sinks
from lumenweir.sources.tables import shared_dir, table
from lumenweir.streaming import retry as R


def call_cap(spark, d) -> DataFrame:
    """The calls that one session of 40 may make."""
    keys = table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"))
    return A.capped(A.pending(keys, log(spark, d), "query_id", "event_id", 60), 40, "query_id")


def invocation_statuses(spark, d) -> DataFrame:
    return A.invocation_statuses(log(spark, d).withColumn("attempt", F.col("event_id") % 3 + 1))


def teacher_ceiling(spark, d) -> DataFrame:
    """Scores of the last answers, as if they were a mode's predictions."""
    gold = rows(spark, d).select("query_id", F.col("label").alias("gold"))
    other = F.when(F.col("gold") == "PRESENT", "ABSENT").otherwise("PRESENT")
    answers = log(spark, d).select("query_id", "event_id", "status").join(gold, "query_id")
    answers = answers.select("query_id", "event_id", "status", F.when(F.col("status") == "disagreed", other).otherwise(F.col("gold")).alias("verdict"))
    out = A.ceiling(gold, answers, "query_id", "event_id").withColumn("mode", F.lit("teacher"))
    return M.scores(out, "mode").select("mode", "n", "invalid", "macro_f1")


def cohort_gate(spark, d) -> DataFrame:
    return C.cohort_gate(rows(spark, d).filter("partition = 'train' AND source_tokens <= 500"), 30)


def first_sources(spark, d) -> DataFrame:
    """The sources in order of their first document."""
    return C.first_occurrences(table(spark, d, "documents"), "source", "doc_id").select("source", F.col("doc_id").alias("first_doc"))


def checkpoint_order(spark, d) -> DataFrame:
    """The checkpoints by number, not by name."""
    names = table(spark, d, "part").select(F.concat(F.lit("checkpoint-"), F.col("p_partkey").cast("string")).alias("name"))
    return names.withColumn("number", T.name_number(F.col("name"))).orderBy(F.desc("number"), "name")


def mode_order(spark, d) -> DataFrame:
    """The modes of a run: base modes before adapters, else as listed."""
    modes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("position"), F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("adapter-"), F.col("s_suppkey").cast("string"))).alias("adapter"))
    return modes.orderBy(F.col("adapter").isNotNull(), "position")


def version_by_label(spark, d) -> DataFrame:
    return rows(spark, d).groupBy("partition", "label", "version").agg(F.count("*").alias("n"))


def number_formats(spark, d) -> DataFrame:
    x = F.when(F.col("item_id") % 5 != 0, F.col("item_id") / F.lit(7.0) - 2)
    return table(spark, d, "benchmark").select("item_id", T.percent_text(x).alias("percent"), T.signed_text(x).alias("signed"))


def retry_episodes(spark, d) -> DataFrame:
    """Ended episodes of three attempts at most, given up after twelve hours, from the events replayed as a stream."""
    events = log(spark, d).select("query_id", "event_id", "status").join(table(spark, d, "events").select("event_id", "ts"), "event_id")
    return R.replayed_episodes(events, 3, timedelta(hours=12))[0]


def retry_rounds(spark, d) -> DataFrame:
    """Calls by round and status, for all customers until each has a terminal record or three attempts."""
    keys = table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"))
    pick = I.drawn(F.concat_ws(":", F.col("query_id").cast("string"), F.col("next_attempt").cast("string")), 4)
    status = F.when(pick < 2, "invalid").when(pick == 2, "disagreed").otherwise("accepted")
    calls, _ = R.retry_rounds(keys, R.hashed_calls(status), f"{shared_dir(spark)}/lumenweir/rounds-{uuid.uuid4().hex}", {"seed": 4}, 3)
    return calls.groupBy("round", "status").agg(F.count("*").alias("n"), F.min("query_id").alias("first_query"))


def published_rows(spark, d) -> DataFrame:
    """Cells of rows that were published as a version, read again through the pointer and held against the manifest."""
    at = f"{shared_dir(spark)}/lumenweir/published-{uuid.uuid4().hex}"
    sinks.commit_version(spark, at, {"rows": rows(spark, d)})
    return sinks.read_version(spark, at, "rows").groupBy("partition", "label").agg(F.count("*").alias("n"), F.sum("source_tokens").alias("tokens"))


QUERIES = {f.__name__: f for f in (published_rows, retry_episodes, retry_rounds, call_cap, invocation_statuses, teacher_ceiling, cohort_gate, first_sources, checkpoint_order, mode_order, version_by_label, number_formats)}
SQL = {
    "published_rows": f"WITH {ROWS} SELECT partition, label, count(*) AS n, CAST(sum(source_tokens) AS BIGINT) AS tokens FROM r GROUP BY ALL",
    "retry_episodes": f"""WITH RECURSIVE {LOG}, e AS (SELECT query_id, event_id, status, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY query_id ORDER BY event_id) AS k FROM log JOIN (SELECT event_id, ts FROM events) USING (event_id)),
        s AS (SELECT query_id, k, ms, event_id, event_id AS first_event, 1 AS attempts, status, status <> 'invalid' AS ended FROM e WHERE k = 1
          UNION ALL SELECT e.query_id, e.k, e.ms, e.event_id, CASE WHEN s.ended OR e.ms - s.ms > 43200000 THEN e.event_id ELSE s.first_event END,
            CASE WHEN s.ended OR e.ms - s.ms > 43200000 THEN 1 ELSE s.attempts + 1 END, e.status, e.status <> 'invalid' OR (NOT s.ended AND e.ms - s.ms <= 43200000 AND s.attempts = 2) FROM s JOIN e ON e.query_id = s.query_id AND e.k = s.k + 1),
        last AS (SELECT *, lead(ms) OVER (PARTITION BY query_id ORDER BY k) AS next_ms, (SELECT max(ms) FROM e) AS now FROM s)
        SELECT query_id, first_event, event_id AS last_event, CAST(attempts AS BIGINT) AS attempts, CASE WHEN status <> 'invalid' THEN status WHEN ended THEN 'exhausted' ELSE 'gave_up' END AS outcome
        FROM last WHERE ended OR coalesce(next_ms, now) - ms > 43200000""",
    "retry_rounds": """WITH a AS (SELECT c_custkey AS query_id, unnest([1, 2, 3]) AS attempt FROM customer),
        s AS (SELECT *, ('0x' || substr(sha256(query_id || ':' || attempt), 1, 8))::BIGINT % 4 AS pick FROM a),
        m AS (SELECT *, coalesce(bool_and(pick < 2) OVER (PARTITION BY query_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS made FROM s)
        SELECT CAST(attempt - 1 AS INTEGER) AS round, CASE WHEN pick < 2 THEN 'invalid' WHEN pick = 2 THEN 'disagreed' ELSE 'accepted' END AS status, count(*) AS n, min(query_id) AS first_query FROM m WHERE made GROUP BY ALL""",
    "call_cap": f"""WITH {LOG}, last AS (SELECT query_id, arg_max(status, event_id) AS status, count(*) AS attempts FROM log GROUP BY 1)
        SELECT c_custkey AS query_id, CAST(coalesce(attempts, 0) + 1 AS BIGINT) AS next_attempt FROM customer LEFT JOIN last ON query_id = c_custkey WHERE NOT coalesce(status <> 'invalid' OR attempts >= 60, FALSE) ORDER BY 1 LIMIT 40""",
    "invocation_statuses": f"WITH {LOG} SELECT status, count(*) AS invocations, CAST(count_if(event_id % 3 = 0) AS BIGINT) AS first_attempts FROM log GROUP BY 1",
    "teacher_ceiling": f"""WITH {ROWS}, {LOG}, last AS (SELECT query_id, arg_max(status, event_id) AS status FROM log GROUP BY 1),
        p AS (SELECT r.label AS gold, CASE status WHEN 'accepted' THEN r.label WHEN 'disagreed' THEN CASE WHEN r.label = 'PRESENT' THEN 'ABSENT' ELSE 'PRESENT' END ELSE 'INVALID' END AS predicted FROM r LEFT JOIN last USING (query_id))
        SELECT 'teacher' AS mode, count(*) AS n, CAST(count_if(predicted = 'INVALID') AS BIGINT) AS invalid, {f1_sql()} AS macro_f1 FROM p""",
    "cohort_gate": f"""WITH {ROWS} SELECT v.label, count(DISTINCT r.group_id) AS groups, count(DISTINCT r.group_id) >= 30 AS passed
        FROM (SELECT unnest(['PRESENT', 'ABSENT']) AS label) v LEFT JOIN r ON r.label = v.label AND r.partition = 'train' AND r.source_tokens <= 500 GROUP BY 1""",
    "first_sources": "SELECT source, min(doc_id) AS first_doc FROM documents GROUP BY 1",
    "checkpoint_order": "SELECT 'checkpoint-' || p_partkey AS name, CAST(p_partkey AS BIGINT) AS number FROM part",
    "mode_order": "SELECT s_suppkey AS position, CASE WHEN s_suppkey % 3 <> 0 THEN 'adapter-' || s_suppkey END AS adapter FROM supplier",
    "version_by_label": f"WITH {ROWS} SELECT partition, label, version, count(*) AS n FROM r GROUP BY ALL",
    "number_formats": "SELECT item_id, coalesce(printf('%.1f%%', x * 100), '—') AS percent, coalesce(printf('%+.3f', x), '—') AS signed FROM (SELECT item_id, CASE WHEN item_id % 5 <> 0 THEN item_id / 7.0::DOUBLE - 2 END AS x FROM benchmark)",
}
