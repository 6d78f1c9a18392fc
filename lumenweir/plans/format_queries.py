"""Queries over chat formatting and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweir.functions import text as T
from lumenweir.operators import formatting as M
from lumenweir.operators import manifest as N
from lumenweir.plans.corpus import CORPUS, ROWS, corpus, rows
from lumenweir.sources.tables import table

SYSTEMS = {"label": "Answer with one word.", "report": "Explain, then answer."}
LIMIT = 700


def chat_render(spark, d) -> DataFrame:
    c = corpus(spark, d)
    m = M.messages(F.lit(SYSTEMS["label"]), F.concat(F.lit("source:\n"), F.col("text")), F.col("label"))
    return c.select(F.col("path").alias("query_id"), F.size(m).cast("bigint").alias("n_messages"), F.sha2(F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit("\x1e"), x["content"])), "\x1f"), 256).alias("messages_sha256"))


def records(spark, d) -> DataFrame:
    targets = {"label": F.col("label"), "report": F.concat(F.lit("The text says "), F.col("label"), F.lit(" in version "), F.col("version"))}
    each = M.by_condition(corpus(spark, d).select(F.col("path").alias("id"), "collection", "label", "text", "version"), SYSTEMS, targets)
    each = each.select("id", "collection", "label", "condition", M.messages(F.col("system"), F.col("text")).alias("prompt"), F.array(F.struct(F.lit("assistant").alias("role"), F.col("target").alias("content"))).alias("completion"))
    return M.with_token_counts(each, lambda t: F.size(T.word_tokens(t))).drop("prompt", "completion")


def multitask_interleave(spark, d) -> DataFrame:
    r = records(spark, d)
    kept = r.join(M.too_long(r, LIMIT), "id", "left_anti")
    return M.interleaved(kept, ("label", "report"), 42).select("id", "condition", "order", F.col("task_rank").cast("bigint").alias("task_rank"), "sequence_tokens")


def token_exposure(spark, d) -> DataFrame:
    return M.exposure(records(spark, d), "condition")


def dry_run_estimate(spark, d) -> DataFrame:
    return records(spark, d).groupBy("condition").agg(F.sum("prompt_tokens").alias("total"), F.max("prompt_tokens").alias("most"), F.round(F.avg("prompt_tokens") * 1000).cast("bigint").alias("for_1000"))


def acceptance_bias(spark, d) -> DataFrame:
    return M.acceptance_bias(rows(spark, d), F.col("source_tokens") <= 500)


def cohort_order(spark, d) -> DataFrame:
    return M.cohort(rows(spark, d).withColumnRenamed("query_id", "id"), 42)


def manifest(spark, d, parts: str = "partition") -> DataFrame:
    r = rows(spark, d)
    return N.content_manifest(r, F.concat(F.col(parts), F.lit(".parquet")), F.concat_ws("|", F.col("query_id").cast("string"), "label", "group_id"))


def evaluation_inputs(spark, d) -> DataFrame:
    """Prompts of all rows and conditions, none left out."""
    return M.evaluation_inputs(records(spark, d), 1_000_000).groupBy("condition").agg(F.count("*").alias("n"), F.max("prompt_tokens").alias("most"), F.sum("prompt_tokens").alias("total"))


def manifest_digest(spark, d) -> DataFrame:
    return N.manifest_digest(manifest(spark, d), ("validation.parquet",))


def manifest_verify(spark, d) -> DataFrame:
    stated = manifest(spark, d)
    found = N.content_manifest(rows(spark, d).filter("partition <> 'test' OR query_id % 2 = 0").replace({"validation": "extra"}, subset=["partition"]), F.concat(F.col("partition"), F.lit(".parquet")), F.concat_ws("|", F.col("query_id").cast("string"), "label", "group_id"))
    return N.verified(stated, found)


def stale_rows(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("stored", F.sha2(F.concat(F.col("text"), F.when(F.col("doc_id") % 10 == 0, F.lit("!")).otherwise("")), 256))
    return N.stale_rows(docs, F.col("text"), F.col("stored")).select("doc_id")


_F = (chat_render, multitask_interleave, token_exposure, dry_run_estimate, acceptance_bias, cohort_order, evaluation_inputs, manifest_digest, manifest_verify, stale_rows)
QUERIES = {f.__name__: f for f in _F}

PARTS = """d AS (SELECT partition || '.parquet' AS name, sha256(query_id || '|' || label || '|' || group_id) AS d, query_id FROM r),
    p AS (SELECT name, substr(d, 1, 3) AS part, sha256(string_agg(d, '' ORDER BY d)) AS s FROM d GROUP BY ALL), m AS (SELECT name, sha256(string_agg(s, '' ORDER BY part)) AS sha256 FROM p GROUP BY 1)"""
RECORDS = f"""WITH {CORPUS}, e AS (SELECT path AS id, label, unnest([{{'c': 'label', 's': 'Answer with one word.', 't': label}}, {{'c': 'report', 's': 'Explain, then answer.', 't': 'The text says ' || label || ' in version ' || version}}]) AS x, text FROM corpus),
    rec AS (SELECT id, x.c AS condition, CAST(len(regexp_extract_all(x.s || chr(10) || text, '[A-Za-z0-9]+')) AS BIGINT) AS prompt_tokens, CAST(len(regexp_extract_all(x.t, '[A-Za-z0-9]+')) AS BIGINT) AS completion_tokens FROM e)"""
SQL = {
    "chat_render": f"""WITH {CORPUS} SELECT path AS query_id, CAST(3 AS BIGINT) AS n_messages, sha256('system' || chr(30) || 'Answer with one word.' || chr(31) || 'user' || chr(30) || 'source:' || chr(10) || text || chr(31) || 'assistant' || chr(30) || label) AS messages_sha256 FROM corpus""",
    "multitask_interleave": RECORDS
    + f""" SELECT id, condition, sha256('[42,"' || id || '"]') AS "order", CAST(CASE condition WHEN 'label' THEN 1 ELSE 2 END AS BIGINT) AS task_rank, prompt_tokens + completion_tokens AS sequence_tokens FROM rec
        WHERE id NOT IN (SELECT id FROM rec WHERE prompt_tokens + completion_tokens > {LIMIT})""",
    "token_exposure": RECORDS + " SELECT condition, CAST(sum(completion_tokens) AS BIGINT) AS completion_total, round(avg(completion_tokens), 1) AS completion_mean, quantile_cont(completion_tokens, 0.5) AS completion_median, max(prompt_tokens + completion_tokens) AS sequence_max FROM rec GROUP BY 1",
    "dry_run_estimate": RECORDS + " SELECT condition, CAST(sum(prompt_tokens) AS BIGINT) AS total, max(prompt_tokens) AS most, CAST(round(avg(prompt_tokens) * 1000) AS BIGINT) AS for_1000 FROM rec GROUP BY 1",
    "evaluation_inputs": RECORDS + " SELECT condition, count(*) AS n, max(prompt_tokens) AS most, CAST(sum(prompt_tokens) AS BIGINT) AS total FROM rec GROUP BY 1",
    "acceptance_bias": f"WITH {ROWS} SELECT collection, label, count(*) AS all_rows, CAST(count_if(source_tokens <= 500) AS BIGINT) AS kept_rows, avg(source_tokens) AS all_tokens, avg(source_tokens) FILTER (source_tokens <= 500) AS kept_tokens FROM r GROUP BY ALL",
    "cohort_order": f"""WITH {ROWS} SELECT partition, sha256('[42,"' || query_id || '"]') AS "order", row_number() OVER (PARTITION BY partition ORDER BY sha256('[42,"' || query_id || '"]')) - 1 AS rank, query_id AS id FROM r""",
    "manifest_digest": f"""WITH {ROWS}, {PARTS} SELECT sha256('{{' || string_agg('"' || name || '":"' || sha256 || '"', ',' ORDER BY name) || '}}') AS digest FROM m WHERE name <> 'validation.parquet'""",
    "manifest_verify": "SELECT * FROM (VALUES ('train.parquet', 'ok'), ('test.parquet', 'changed'), ('validation.parquet', 'missing'), ('extra.parquet', 'unexpected')) v(name, state)",
    "stale_rows": "SELECT doc_id FROM documents WHERE doc_id % 10 = 0 AND text IS NOT NULL",
}
