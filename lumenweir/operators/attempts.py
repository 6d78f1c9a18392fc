"""Attempt logs: the latest record of each key, terminal and pending keys, and summaries of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweir.functions.strict_json import parsed

STATUSES = ("accepted", "disagreed", "unsupported", "invalid", "pending")


def latest(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last record of each key by `order`: one partial aggregate, no sort."""
    rest = [c for c in log.columns if c not in (key, order)]
    last = F.max_by(F.struct(*rest), order).alias("r")
    return log.groupBy(key).agg(F.max(order).alias(order), last, F.count("*").alias("attempts")).select(key, order, "r.*", "attempts")


def terminal(last: DataFrame, most_attempts: int) -> Column:
    """A key is done when its last status isn't invalid, or its attempts are used up."""
    return (F.col("status") != "invalid") | (F.col("attempts") >= most_attempts)


def pending(keys: DataFrame, log: DataFrame, key: str, order: str, most_attempts: int) -> DataFrame:
    """keys without a terminal record, with the number of their next attempt."""
    last = latest(log, key, order)
    done = last.filter(terminal(last, most_attempts)).select(key)
    tries = last.select(key, "attempts")
    return keys.join(done, key, "left_anti").join(tries, key, "left").withColumn("next_attempt", F.coalesce(F.col("attempts"), F.lit(0)) + 1).drop("attempts")


def statuses(keys: DataFrame, log: DataFrame, key: str, order: str, most_attempts: int) -> DataFrame:
    """keys with status: that of a terminal record, else pending."""
    last = latest(log, key, order)
    done = last.filter(terminal(last, most_attempts)).select(key, F.col("status"))
    return keys.join(done, key, "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def status_counts(rows: DataFrame) -> DataFrame:
    """status, n for every status there is, 0 where none has it."""
    domain = rows.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return F.broadcast(domain).join(rows.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def agreement(rows: DataFrame, *by: str) -> DataFrame:
    """n, judged, agreement_rate (null if nothing was judged), by the given columns."""
    accepted, judged = F.count_if(F.col("status") == "accepted"), F.count_if(F.col("status").isin("accepted", "disagreed"))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), judged.alias("judged"), F.try_divide(accepted, judged).alias("agreement_rate"))


def complete_pairs(rows: DataFrame) -> DataFrame:
    """matched_pairs, complete_pairs: pairs of a PRESENT row with its partner in the run, and those of which both are accepted.

    rows: query_id, label, match_partner, status."""
    other = rows.select(F.col("query_id").alias("match_partner"), F.col("status").alias("other"))
    pairs = rows.filter("label = 'PRESENT'").join(other, "match_partner")
    return pairs.agg(F.count("*").alias("matched_pairs"), F.count_if((F.col("status") == "accepted") & (F.col("other") == "accepted")).alias("complete_pairs"))


def usage_sums(events: DataFrame, raw: str, keys: list[str], *by: str) -> DataFrame:
    """Sum of each integer of a JSON text by key (null if none is there), and the rows without any of them."""
    tree = parsed(F.col(raw))
    value = {k: F.when(F.schema_of_variant(F.try_variant_get(tree, f"$.{k}", "variant")).rlike("INT$"), F.try_variant_get(tree, f"$.{k}", "bigint")) for k in keys}
    rows = events.select(*by, *(v.alias(k) for k, v in value.items()))
    none = F.count_if(F.coalesce(*(F.col(k) for k in keys)).isNull())
    return rows.groupBy(*by).agg(*(F.sum(k).alias(k) for k in keys), none.alias("without_usage"))


def run_summary(log: DataFrame) -> DataFrame:
    """invocations, retries, keys: of an attempt log with its attempt numbers."""
    return log.agg(F.count("*").alias("invocations"), F.count_if(F.col("attempt") > 1).alias("retries"), F.countDistinct("query_id").alias("keys"))


def capped(pending_keys: DataFrame, most: int, key: str) -> DataFrame:
    """The keys that one session may call: at most `most`, by key."""
    return pending_keys.orderBy(key).limit(most)


def invocation_statuses(log: DataFrame) -> DataFrame:
    """status, invocations, first_attempts: how the calls of a log ended; log has the attempt number."""
    return log.groupBy("status").agg(F.count("*").alias("invocations"), F.count_if(F.col("attempt") == 1).alias("first_attempts"))


def ceiling(gold: DataFrame, log: DataFrame, key: str, order: str) -> DataFrame:
    """gold with predicted: the verdict of the last answer if that was accepted or disagreed, else INVALID.

    log: key, order, status, verdict. A row without any answer is INVALID too.
    """
    last = latest(log.select(key, order, "status", "verdict"), key, order)
    said = last.select(key, F.when(F.col("status").isin("accepted", "disagreed"), F.col("verdict")).alias("predicted"))
    return gold.join(said, key, "left").withColumn("predicted", F.coalesce("predicted", F.lit("INVALID")))
