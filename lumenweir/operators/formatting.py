"""Chat records for training and evaluation: messages, targets, token accounting, length limits, interleaving, cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweir.functions.identity import rounded, seeded
from lumenweir.operators.ranks import ranked


def messages(system: Column, user: Column, assistant: Column | None = None) -> Column:
    """array<struct<role, content>>: system, user and, if given, the assistant's answer."""
    turns = [("system", system), ("user", user)] + ([("assistant", assistant)] if assistant is not None else [])
    return F.array(*(F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in turns))


def by_condition(rows: DataFrame, systems: dict[str, str], targets: dict[str, Column]) -> DataFrame:
    """rows times conditions, with condition, system and target: one small array exploded, no join."""
    each = F.array(*(F.struct(F.lit(c).alias("condition"), F.lit(s).alias("system"), targets[c].alias("target")) for c, s in systems.items()))
    return rows.withColumn("_c", F.explode(each)).select(*rows.columns, "_c.*")


def with_token_counts(records: DataFrame, count, prompt: str = "prompt", completion: str = "completion") -> DataFrame:
    """prompt_tokens, completion_tokens, sequence_tokens of message arrays, by a function from a text column to its tokens."""
    text = lambda c: F.array_join(F.transform(c, lambda m: m["content"]), "\n")
    n = count(text(F.col(prompt)))
    whole = n + count(text(F.col(completion)))
    return records.withColumn("prompt_tokens", n.cast("bigint")).withColumn("sequence_tokens", whole.cast("bigint")).withColumn("completion_tokens", F.col("sequence_tokens") - F.col("prompt_tokens"))


def too_long(records: DataFrame, limit: int, key: str = "id") -> DataFrame:
    """Keys that are too long in any condition: they leave all of them."""
    return records.groupBy(key).agg(F.max("sequence_tokens").alias("m")).filter(F.col("m") > limit).select(key)


def interleaved(records: DataFrame, tasks: tuple[str, ...], seed: int, key: str = "id") -> DataFrame:
    """The records of the tasks, task by task for each key, in one seeded order of keys: sorted by (order, task_rank)."""
    rank = F.array_position(F.array(*map(F.lit, tasks)), F.col("condition"))
    return records.filter(F.col("condition").isin(*tasks)).select("*", seeded(seed, F.col(key)).alias("order"), rank.alias("task_rank"))


def cohort(rows: DataFrame, seed: int) -> DataFrame:
    """partition, order, rank, id: the shared order of each partition's ids, for a cohort file; rank counts from 0."""
    own = rows.select("partition", seeded(seed, F.col("id")).alias("order"), "id")
    return ranked(own, "partition", F.substring("order", 1, 2), ["order", "id"], "rank")


def cohort_file(rows: DataFrame, exclusions: DataFrame, seed: int) -> DataFrame:
    """partition, rank, id, reason: the cohort's ids in order, then the excluded ones (rank null) with their reasons.

    exclusions: partition, id, reason."""
    kept = cohort(rows, seed).select("partition", "rank", "id", F.lit(None).cast("string").alias("reason"))
    return kept.unionByName(exclusions.select("partition", F.lit(None).cast("bigint").alias("rank"), "id", "reason"))


def evaluation_inputs(records: DataFrame, budget: int) -> DataFrame:
    """records, all of them: a prompt over the budget of tokens is an error that names it, never a row left out."""
    over = F.raise_error(F.concat(F.lit("prompt of "), F.col("id").cast("string"), F.lit(f" is over {budget} tokens")))
    return records.withColumn("prompt_tokens", F.when(F.col("prompt_tokens") > budget, over.cast("bigint")).otherwise(F.col("prompt_tokens")))


def exposure(records: DataFrame, *by: str) -> DataFrame:
    """Totals, means to one digit, medians and longest of token counts by condition."""
    return records.groupBy(*by).agg(
        F.sum("completion_tokens").alias("completion_total"),
        rounded(F.avg("completion_tokens"), 1).alias("completion_mean"),
        F.percentile("completion_tokens", F.lit(0.5)).alias("completion_median"),
        F.max("sequence_tokens").alias("sequence_max"),
    )


def acceptance_bias(rows: DataFrame, kept: Column) -> DataFrame:
    """collection, label, all, kept, mean source tokens of both: what filtering changed."""
    return rows.groupBy("collection", "label").agg(
        F.count("*").alias("all_rows"),
        F.count_if(kept).alias("kept_rows"),
        F.avg("source_tokens").alias("all_tokens"),
        F.avg(F.when(kept, F.col("source_tokens"))).alias("kept_tokens"),
    )
