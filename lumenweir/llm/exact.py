"""Exact dedup by content-defined chunk recipes, in DataFrame functions alone.

A text is cut at the first punctuation mark or line end after MIN_CHUNK characters (at most MAX_CHUNK), so that cuts follow
the content. Each chunk is named by a 128-bit identifier; a pass over the distinct chunks verifies that no identifier names
two contents. Documents are then compared by their ordered identifier lists, which are a small part of the texts' size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweir.llm.common import documents, stored

MIN_CHUNK, MAX_CHUNK = 512, 4096
CHUNK = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 1}}}?[.,;:!?\n]|.{{1,{MAX_CHUNK}}}"


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CHUNK), F.lit(0))


def named(chunk: Column, salt: int) -> Column:
    return F.struct(F.xxhash64(F.lit(2 * salt), chunk).alias("a"), F.xxhash64(chunk, F.lit(2 * salt + 1)).alias("b"))


def verified_salt(docs: DataFrame, tries: int = 5) -> int:
    """A salt under which every identifier of docs names one content. Each try compares the contents of all chunks of an
    identifier, combined on the map side first, so repeated chunks move once a task."""
    for salt in range(tries):
        own = docs.select(F.explode(chunks(F.col("text"))).alias("chunk")).select(named(F.col("chunk"), salt).alias("id"), "chunk")
        one = own.groupBy("id.a", "id.b").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
        if one.filter("low <> high").isEmpty():
            return salt
    raise ValueError("every salt gave one identifier to two chunks")


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs, dropped ones too.

    Texts are equal when identical; null counts as empty. The row with the largest doc_id of a group stays; null doc_ids
    are smaller than all others, and a group of null doc_ids alone keeps one of them (keep_id null). Of rows that repeat
    both doc_id and text one is kept. Empty table: empty result. Other columns are not read. Groups are counted by partial
    aggregation, and the join back is a plain sort-merge join, which adaptive execution splits where a group is hot.
    """
    rows, groups = _groups(docs)
    each = rows.join(groups, "recipe").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def _groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_sha256, recipe, copies) of the distinct rows, and (recipe, keep_id, group_size) of the groups."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    salt = verified_salt(docs)
    recipes = docs.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.transform(chunks(F.col("text")), lambda c: named(c, salt)).alias("recipe"))
    rows = stored(recipes.groupBy("doc_id", "text_sha256", "recipe").agg(F.count("*").alias("copies")), "recipes")
    groups = rows.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    return rows, stored(groups, "groups")  # stored, else a join keeps the aggregate's partitions, which can't be split


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_groups() keeps, with all their columns, whatever their names. Of rows that repeat doc_id
    and text one stays, whichever its other columns are."""
    rows, groups = _groups(docs)
    keep = rows.join(groups, "recipe").filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    keep = stored(keep.select(F.col("doc_id").alias("k"), F.col("text_sha256").alias("s"), "copies"), "keep")
    every = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    own = docs.select(every, F.col("doc_id").alias("i"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("t"))
    found = own.join(keep, F.col("i").eqNullSafe(F.col("k")) & (F.col("t") == F.col("s")))
    if keep.filter("copies > 1").isEmpty():
        return found.select("row.*")
    # whole rows are dealt again only where they repeat
    once, many = found.filter("copies = 1").select("row"), found.filter("copies > 1")
    return once.unionByName(many.groupBy("i", "t").agg(F.first("row").alias("row")).select("row")).select("row.*")


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


QUERIES = {"op9_exact_dedup": op9_exact_dedup}
SQL = {
    "op9_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)
    """
}
