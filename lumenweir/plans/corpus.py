"""Stand-ins over the driver's tables: a labelled corpus with collections, origins, versions and groups, and derived outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweir.functions import identity as I
from lumenweir.functions import text as T
from lumenweir.operators.curation import hash_partition
from lumenweir.sources.tables import table


def corpus(spark, d) -> DataFrame:
    """path, collection, label, origin, text, identity, version: documents with a quality label."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("path"),
        F.col("lang").alias("collection"),
        F.when(F.col("quality") == 1, "PRESENT").otherwise("ABSENT").alias("label"),
        F.col("source").alias("origin"),
        F.coalesce("text", F.lit("")).alias("text"),
        I.sha(F.coalesce("text", F.lit(""))).alias("identity"),
        F.concat(F.lit("0."), (F.col("doc_id") % 4 + 4).cast("string")).alias("version"),
    )


CORPUS = """corpus AS (SELECT doc_id AS path, lang AS collection, CASE WHEN quality = 1 THEN 'PRESENT' ELSE 'ABSENT' END AS label, source AS origin,
    coalesce(text, '') AS text, sha256(coalesce(text, '')) AS identity, '0.' || (doc_id % 4 + 4) AS version FROM documents JOIN labels USING (doc_id))"""


def rows(spark, d) -> DataFrame:
    """query_id, collection, label, version, group_id (of the text), partition by the group's hash, source_tokens."""
    c = corpus(spark, d)
    return c.select(F.col("path").alias("query_id"), "collection", "label", "version", F.col("identity").alias("group_id"), hash_partition(F.col("identity")).alias("partition"), F.size(T.word_tokens(F.col("text"))).cast("bigint").alias("source_tokens"))


ROWS = f"""{CORPUS}, q AS (SELECT path AS query_id, collection, label, version, identity AS group_id,
    ('0x' || substr(sha256(identity), 1, 8))::BIGINT % 8 AS fold, CAST(len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS BIGINT) AS source_tokens FROM corpus),
    r AS (SELECT * EXCLUDE fold, CASE WHEN fold IN (0, 1) THEN 'test' WHEN fold = 2 THEN 'validation' ELSE 'train' END AS partition FROM q)"""

MODES = ("label", "report", "report_vf")
SEEDS = (42, 43, 44)


def derived(gold: Column, key: Column) -> Column:
    """A prediction by the key's hash: mostly right, sometimes always PRESENT, wrong, or INVALID."""
    h = I.drawn(key, 10)
    return F.when(h < 6, gold).when(h < 8, "PRESENT").when(h < 9, "ABSENT").otherwise("INVALID")


def predictions(spark, d) -> DataFrame:
    """mode, seed, id, gold, predicted, collection, group_id (500 groups by hash of the origin and id)."""
    c = corpus(spark, d).select("path", "collection", "label")
    each = c.withColumn("mode", F.explode(F.array(*map(F.lit, MODES)))).withColumn("seed", F.explode(F.array(*map(F.lit, SEEDS))))
    key = F.concat_ws(":", "mode", F.col("seed").cast("string"), F.col("path").cast("string"))
    return each.select("mode", "seed", F.col("path").alias("id"), F.col("label").alias("gold"), derived(F.col("label"), key).alias("predicted"), "collection", I.drawn(F.col("path").cast("string"), 500).alias("group_id"))


def draw(key: str, n: int | str) -> str:
    return f"('0x' || substr(sha256({key}), 1, 8))::BIGINT % {n}"


PREDICTIONS = f"""{CORPUS}, each_row AS (SELECT *, unnest(['label', 'report', 'report_vf']) AS mode FROM corpus), seeded AS (SELECT *, unnest([42, 43, 44]) AS seed FROM each_row),
    hashed AS (SELECT *, {draw("mode || ':' || seed || ':' || path", 10)} AS h FROM seeded),
    pred AS (SELECT mode, seed, path AS id, label AS gold, CASE WHEN h < 6 THEN label WHEN h < 8 THEN 'PRESENT' WHEN h < 9 THEN 'ABSENT' ELSE 'INVALID' END AS predicted,
      collection, {draw("CAST(path AS VARCHAR)", 500)} AS group_id FROM hashed)"""


def log(spark, d) -> DataFrame:
    """An attempt log from events: user_id is the key, event_id the order; the status follows the event's type."""
    status = F.create_map(*map(F.lit, [x for kv in {"click": "invalid", "view": "accepted", "purchase": "disagreed"}.items() for x in kv]))
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("query_id"), "event_id", F.coalesce(F.try_element_at(status, F.col("event_type")), F.lit("invalid")).alias("status"), "event_type", "props")


LOG = """log AS (SELECT user_id AS query_id, event_id, CASE event_type WHEN 'view' THEN 'accepted' WHEN 'purchase' THEN 'disagreed' ELSE 'invalid' END AS status, event_type, props FROM events)"""
