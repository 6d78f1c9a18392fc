"""Queries over JSON reports, answers and attempt logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweir.functions import identity as I
from lumenweir.functions import reports as R
from lumenweir.operators import attempts as A
from lumenweir.plans.corpus import LOG, ROWS, log, rows
from lumenweir.sources.tables import stored, table
from lumenweir.streaming.attempt_log import replayed

LINES = 40


def raw_report(i: Column, label: Column) -> Column:
    """A report by the row's number; every eleventh kind of fault in turn."""
    k = i % 11
    n = (i % 30 + 1).cast("string")
    end = (i % 30 + 1 + i % 5).cast("string")
    place = F.concat(F.lit('{"start_line":'), n, F.lit(',"end_line":'), end, F.lit(',"function":'), F.when(i % 2 == 0, F.lit("null")).otherwise(F.lit('"f"')), F.lit("}"))
    where = F.when(label == "PRESENT", place).otherwise(F.lit("null"))
    good = F.concat(F.lit('{"analysis":"Line '), n, F.lit(' matters.","verdict":"'), label, F.lit('","location":'), where, F.lit("}"))
    return (
        F.when(k == 1, F.concat(F.lit('{"verdict":"'), label, F.lit('","analysis":"swapped","location":'), where, F.lit("}")))
        .when(k == 2, F.replace(good, F.lit('"verdict"'), F.lit('"analysis":"again","verdict"')))
        .when(k == 3, F.replace(good, F.lit(',"end_line":'), F.lit(',"extra":1,"end_line":')))
        .when(k == 4, F.concat(F.lit("not "), good))
        .when(k == 5, F.concat(F.lit('{"analysis":"  ","verdict":"'), label, F.lit('","location":'), where, F.lit("}")))
        .when(k == 6, F.concat(F.lit('{"analysis":"flipped","verdict":"'), F.when(label == "PRESENT", "ABSENT").otherwise("PRESENT"), F.lit('","location":'), where, F.lit("}")))
        .when(k == 7, F.concat(F.lit('{"analysis":"text line","verdict":"PRESENT","location":{"start_line":"3","end_line":4,"function":null}}')))
        .when(k == 8, F.concat(F.lit('{"analysis":"far","verdict":"PRESENT","location":{"start_line":3,"end_line":41,"function":null}}')))
        .otherwise(good)
    )


def raw_rows(spark, d) -> DataFrame:
    r = rows(spark, d)
    return r.select("query_id", "collection", "label", raw_report(F.col("query_id"), F.col("label")).alias("raw"))


def report_validate(spark, d) -> DataFrame:
    r = raw_rows(spark, d)
    return r.select("query_id", R.verdict_of(F.col("raw"), F.lit(LINES)).alias("predicted"), R.verdict_of(F.col("raw"), F.lit(LINES), "verdict_first").alias("predicted_vf"))


def report_canonical(spark, d) -> DataFrame:
    r = raw_rows(spark, d).filter(R.valid_report(F.col("raw"), F.lit(LINES)))
    return r.select("query_id", R.canonical_report(F.col("raw")).alias("canonical"), R.canonical_report(F.col("raw"), "verdict_first").alias("canonical_vf"), I.sha(R.canonical_report(F.col("raw"))).alias("canonical_sha256"))


def label_verdicts(spark, d) -> DataFrame:
    raw = F.concat(F.when(F.col("query_id") % 3 == 0, F.lit(" \n")).otherwise(""), F.when(F.col("query_id") % 5 == 0, F.lower("label")).otherwise(F.col("label")), F.when(F.col("query_id") % 7 == 0, F.lit("\t.")).otherwise("\t"))
    return rows(spark, d).select("query_id", R.label_verdict(raw).alias("predicted"), R.forced_verdict(F.ltrim(raw)).alias("forced"))


def answers(spark, d) -> DataFrame:
    r = raw_rows(spark, d)
    k = F.col("query_id") % 5
    raw = F.when(k == 0, F.lit('{"status":"UNSUPPORTED","report":null,"reason_code":"INSUFFICIENT_CONTEXT"}')).when(k == 1, F.lit('{"status":"UNSUPPORTED","report":null,"reason_code":null}')).otherwise(F.concat(F.lit('{"status":"OK","report":'), F.col("raw"), F.lit(',"reason_code":null}')))
    return r.select("query_id", "collection", "label", F.col("raw").alias("report"), raw.alias("raw"))


def assessed(spark, d) -> DataFrame:
    a = answers(spark, d)
    return a.select("query_id", "collection", "label", R.answer_status(F.col("raw"), F.lit(LINES), F.col("label"), F.length("report"), 10_000).alias("status"))


def assess_status(spark, d) -> DataFrame:
    return assessed(spark, d).groupBy("collection", "label", "status").agg(F.count("*").alias("n"))


def agreement_rate(spark, d) -> DataFrame:
    return A.agreement(assessed(spark, d), "collection")


def status_counts(spark, d) -> DataFrame:
    return A.status_counts(assessed(spark, d))


def complete_pairs(spark, d) -> DataFrame:
    """A row's partner is the next row id of the other parity."""
    partner = F.when(F.col("query_id") % 2 == 0, F.col("query_id") + 1).otherwise(F.col("query_id") - 1)
    return A.complete_pairs(stored(assessed(spark, d), "assessed").withColumn("match_partner", partner))


def event_usage_sum(spark, d) -> DataFrame:
    raw = F.when(F.col("event_id") % 9 == 0, F.concat(F.col("props"), F.lit("}"))).when(F.col("event_id") % 7 == 0, F.lit('{"k":"7"}')).otherwise(F.col("props"))
    return A.usage_sums(table(spark, d, "events").withColumn("raw", raw), "raw", ["k", "none"], "event_type")


def attempt_latest(spark, d) -> DataFrame:
    return A.latest(log(spark, d).select("query_id", "event_id", "status"), "query_id", "event_id")


def attempt_terminal(spark, d) -> DataFrame:
    last = attempt_latest(spark, d)
    return last.select("query_id", "status", "attempts", A.terminal(last, 60).alias("terminal"))


def attempt_pending(spark, d) -> DataFrame:
    keys = table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"))
    return A.pending(keys, log(spark, d), "query_id", "event_id", 60)


def attempt_summary(spark, d) -> DataFrame:
    return A.run_summary(log(spark, d).withColumn("attempt", F.lit(1) + (F.col("event_id") % 3)))


def attempt_stream(spark, d) -> DataFrame:
    return replayed(log(spark, d).select("query_id", "event_id", "status"), 60)


_F = (report_validate, report_canonical, label_verdicts, assess_status, agreement_rate, status_counts, complete_pairs, event_usage_sum, attempt_latest, attempt_terminal, attempt_pending, attempt_summary, attempt_stream)
QUERIES = {f.__name__: f for f in _F}

RAW = f"""WITH {ROWS}, g AS (SELECT query_id AS i, collection, label, CASE WHEN label = 'PRESENT' THEN '{{"start_line":' || (query_id % 30 + 1) || ',"end_line":' || (query_id % 30 + 1 + query_id % 5) || ',"function":'
      || CASE WHEN query_id % 2 = 0 THEN 'null' ELSE '"f"' END || '}}' ELSE 'null' END AS place FROM r),
    h AS (SELECT *, '{{"analysis":"Line ' || (i % 30 + 1) || ' matters.","verdict":"' || label || '","location":' || place || '}}' AS good FROM g),
    raw AS (SELECT i, collection, label, place, CASE i % 11 WHEN 1 THEN '{{"verdict":"' || label || '","analysis":"swapped","location":' || place || '}}'
      WHEN 2 THEN replace(good, '"verdict"', '"analysis":"again","verdict"') WHEN 3 THEN replace(good, ',"end_line":', ',"extra":1,"end_line":') WHEN 4 THEN 'not ' || good
      WHEN 5 THEN '{{"analysis":"  ","verdict":"' || label || '","location":' || place || '}}'
      WHEN 6 THEN '{{"analysis":"flipped","verdict":"' || CASE WHEN label = 'PRESENT' THEN 'ABSENT' ELSE 'PRESENT' END || '","location":' || place || '}}'
      WHEN 7 THEN '{{"analysis":"text line","verdict":"PRESENT","location":{{"start_line":"3","end_line":4,"function":null}}}}'
      WHEN 8 THEN '{{"analysis":"far","verdict":"PRESENT","location":{{"start_line":3,"end_line":41,"function":null}}}}' ELSE good END AS raw FROM h),
    p AS (SELECT i, collection, label, raw, json_valid(raw) AS ok, CASE WHEN json_valid(raw) THEN raw END AS j FROM raw),
    v AS (SELECT *, json_keys(j) AS keys, j ->> '$.analysis' AS analysis, j ->> '$.verdict' AS verdict, json_type(j, '$.location') AS lt,
      CASE WHEN json_type(j, '$.location') = 'OBJECT' THEN json_keys(j, '$.location') END AS lk, json_type(j, '$.location.start_line') AS st, json_type(j, '$.location.end_line') AS et,
      TRY_CAST(j ->> '$.location.start_line' AS BIGINT) AS s, TRY_CAST(j ->> '$.location.end_line' AS BIGINT) AS e FROM p),
    b AS (SELECT *, coalesce(regexp_matches(analysis, '\\S') AND verdict IN ('PRESENT', 'ABSENT') AND CASE WHEN verdict = 'PRESENT' THEN list_sort(lk) = ['end_line', 'function', 'start_line'] AND st = 'UBIGINT' AND et = 'UBIGINT'
      AND s >= 1 AND e >= s AND e <= 40 ELSE lt = 'NULL' END, FALSE) AS body FROM v)"""
STATUS = (
    RAW
    + """, s AS (SELECT i AS query_id, collection, label, CASE WHEN i % 5 = 0 THEN 'unsupported' WHEN i % 5 = 1 THEN 'invalid'
      WHEN body AND list_sort(keys) = ['analysis', 'location', 'verdict'] AND verdict = label THEN 'accepted' WHEN body AND list_sort(keys) = ['analysis', 'location', 'verdict'] THEN 'disagreed' ELSE 'invalid' END AS status FROM b)"""
)
LAST = f"WITH {LOG}, last AS (SELECT query_id, max(event_id) AS event_id, arg_max(status, event_id) AS status, count(*) AS attempts FROM log GROUP BY 1)"
SQL = {
    "report_validate": RAW + " SELECT i AS query_id, CASE WHEN body AND keys = ['analysis', 'verdict', 'location'] THEN verdict ELSE 'INVALID' END AS predicted, CASE WHEN body AND keys = ['verdict', 'analysis', 'location'] THEN verdict ELSE 'INVALID' END AS predicted_vf FROM b",
    "report_canonical": RAW
    + """, c AS (SELECT i, analysis, verdict, CASE WHEN lt = 'NULL' THEN 'null' ELSE '{"start_line":' || s || ',"end_line":' || e || ',"function":' || (j -> '$.location.function')::VARCHAR || '}' END AS loc FROM b WHERE body AND keys = ['analysis', 'verdict', 'location'])
        SELECT i AS query_id, '{"analysis":"' || analysis || '","verdict":"' || verdict || '","location":' || loc || '}' AS canonical, '{"verdict":"' || verdict || '","analysis":"' || analysis || '","location":' || loc || '}' AS canonical_vf,
          sha256('{"analysis":"' || analysis || '","verdict":"' || verdict || '","location":' || loc || '}') AS canonical_sha256 FROM c""",
    "label_verdicts": f"""WITH {ROWS} SELECT query_id, CASE WHEN query_id % 5 = 0 OR query_id % 7 = 0 THEN 'INVALID' ELSE label END AS predicted,
        CASE WHEN query_id % 5 = 0 THEN 'INVALID' WHEN query_id % 3 = 0 THEN 'INVALID' ELSE label END AS forced FROM r""",
    "assess_status": STATUS + " SELECT collection, label, status, count(*) AS n FROM s GROUP BY ALL",
    "agreement_rate": STATUS + " SELECT collection, count(*) AS n, CAST(count_if(status IN ('accepted', 'disagreed')) AS BIGINT) AS judged, count_if(status = 'accepted') / nullif(count_if(status IN ('accepted', 'disagreed')), 0) AS agreement_rate FROM s GROUP BY 1",
    "status_counts": STATUS + " SELECT d.status, count(s.status) AS n FROM (SELECT unnest(['accepted', 'disagreed', 'unsupported', 'invalid', 'pending']) AS status) d LEFT JOIN s ON s.status = d.status GROUP BY 1",
    "complete_pairs": STATUS
    + " SELECT count(*) AS matched_pairs, CAST(count_if(a.status = 'accepted' AND b.status = 'accepted') AS BIGINT) AS complete_pairs FROM s a JOIN s b ON b.query_id = CASE WHEN a.query_id % 2 = 0 THEN a.query_id + 1 ELSE a.query_id - 1 END WHERE a.label = 'PRESENT'",
    "event_usage_sum": """WITH e AS (SELECT event_type, CASE WHEN event_id % 9 <> 0 AND event_id % 7 <> 0 THEN CAST(props ->> '$.k' AS BIGINT) END AS k FROM events)
        SELECT event_type, CAST(sum(k) AS BIGINT) AS k, CAST(NULL AS BIGINT) AS "none", CAST(count_if(k IS NULL) AS BIGINT) AS without_usage FROM e GROUP BY 1""",
    "attempt_latest": LAST + " SELECT query_id, event_id, status, attempts FROM last",
    "attempt_terminal": LAST + " SELECT query_id, status, attempts, status <> 'invalid' OR attempts >= 60 AS terminal FROM last",
    "attempt_pending": LAST
    + " SELECT c_custkey AS query_id, CAST(coalesce(attempts, 0) + 1 AS BIGINT) AS next_attempt FROM customer LEFT JOIN last ON query_id = c_custkey WHERE NOT coalesce(status <> 'invalid' OR attempts >= 60, FALSE)",
    "attempt_summary": "SELECT count(*) AS invocations, CAST(count_if(event_id % 3 > 0) AS BIGINT) AS retries, count(DISTINCT user_id) AS keys FROM events",
    "attempt_stream": LAST + " SELECT query_id, event_id, status, attempts, status <> 'invalid' OR attempts >= 60 AS terminal FROM last",
}
