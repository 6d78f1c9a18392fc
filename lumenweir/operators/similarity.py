"""Exact set-similarity self-join by prefix filtering over globally rarest shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenweir.functions.identity import rounded
from lumenweir.sources.tables import stored


def runs(tokens: Column, size: int, by: str) -> Column:
    """Hashes of each `size` consecutive tokens. tokens should be a plain column: an expression is evaluated for each run."""
    return F.transform(F.sequence(F.lit(1), F.size(tokens) - size + 1), lambda i: F.xxhash64(F.array_join(F.slice(tokens, i, F.lit(size)), by)))


def shingles(tokens: Column, size: int = 5, by: str = "\x1f") -> Column:
    """Distinct hashed runs of `size` tokens; none if there are fewer tokens. Tokens are joined by `by`."""
    return F.when(F.size(tokens) >= size, F.array_distinct(runs(tokens, size, by))).otherwise(F.array().cast("array<bigint>"))


#: Words of 64 bits of a unit's parity sketch.
SKETCH = 4
#: Grams that a partition is meant to hold, so that it is sorted in memory.
PART_GRAMS = 1 << 21
#: Keys that are broadcast, so that the rows without them needn't move; more are joined.
MOST_KEYS = 1 << 20


def parts_of(spark: SparkSession, rows: int, each: int = PART_GRAMS) -> int:
    """Partitions for so many rows, at least the session's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def without_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows that the stored table keys, of some of their columns, doesn't have; rows stay where they are if the keys are few."""
    return rows.join(F.broadcast(keys) if keys.count() <= MOST_KEYS else keys, keys.columns, "left_anti")


def clone_candidates(units: DataFrame, threshold: float = 0.85, length_ratio: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(candidates, sets): left, right, ma, mb of the pairs that may have this similarity, and key, grams that other units have too.

    units (key, n, grams) must be rows of a stored table, units with grams; a key is one unit. Every gram moves twice at most, to
    the units that have it too and, if there are any, back to its unit. Each unit is indexed under its rarest grams only, m -
    ceil(threshold * m) + 1 of its m; similar sets must share one of them. Grams of one unit alone are the rarest, so they
    only shorten its index. Pairs that meet are counted, and three bounds on what they can share are taken before any set
    moves: by sizes; by the grams left after the last one that they meet at; and by a parity sketch of the grams, whose
    differing bits are no more than the grams that differ.
    """
    t = F.lit(float(threshold))
    sized = units.select("key", "n", F.size("grams").alias("m"), "grams")
    n_grams = units.agg(F.sum(F.size("grams"))).first()[0] or 0
    parts = parts_of(units.sparkSession, n_grams)
    each = sized.select("key", F.explode("grams").alias("g")).repartition(parts, "g")
    frequent = each.withColumn("df", F.count("*").over(Window.partitionBy("g"))).filter("df > 1").repartition(parts, "key")
    word, bit = F.shiftright("g", 6).bitwiseAND(SKETCH - 1), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("g").bitwiseAND(63).cast("int"))
    sketch = [F.coalesce(F.bit_xor(F.when(word == i, bit)), F.lit(0).cast("bigint")).alias(f"s{i}") for i in range(SKETCH)]
    sizes = sized.groupBy("key").agg(F.max("n").alias("n"), F.max("m").alias("m"))
    ranked = frequent.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("order"), *sketch).join(sizes, "key")
    ranked = stored(ranked.select("key", "n", "m", F.size("order").alias("k"), F.col("order.g").alias("grams"), *(f"s{i}" for i in range(SKETCH))), "ranked")
    alone = F.col("m") - F.col("k")
    indexed = F.col("m") - F.ceil(t * F.col("m")).cast("int") + 1 - alone
    prefix = ranked.filter(indexed > 0).select("key", "n", "m", "k", *(f"s{i}" for i in range(SKETCH)), F.posexplode(F.slice("grams", F.lit(1), indexed)).alias("at", "g"))
    prefix = stored(prefix.withColumn("at", F.col("at") + 1), "prefix")
    fields = ["key", "n", "m", "k", "at", *(f"s{i}" for i in range(SKETCH))]
    a, b = (prefix.select("g", *(F.col(c).alias(f"{c}{x}") for c in fields)) for x in "ab")
    ratio = lambda x, y, least: F.least(x, y) >= F.lit(float(least)) * F.greatest(x, y)
    met = a.join(b, "g").filter((F.col("keya") < F.col("keyb")) & ratio("ma", "mb", threshold) & ratio("na", "nb", length_ratio))
    whole = [f"{c}{x}" for x in "ab" for c in fields if c != "at"]
    met = met.groupBy(*whole).agg(F.count("*").alias("shared"), F.max("ata").alias("ata"), F.max("atb").alias("atb"))
    left = F.col("shared") + F.least(F.col("ka") - F.col("ata"), F.col("kb") - F.col("atb"))
    differ = sum((F.bit_count(F.col(f"s{i}a").bitwiseXOR(F.col(f"s{i}b"))) for i in range(1, SKETCH)), F.bit_count(F.col("s0a").bitwiseXOR(F.col("s0b"))))
    most = F.least(left, F.floor((F.col("ka") + F.col("kb") - differ) / 2))
    may = met.filter(most / (F.col("ma") + F.col("mb") - most) >= t)
    return may.select(F.col("keya").alias("left"), F.col("keyb").alias("right"), "ma", "mb"), ranked.select("key", "grams")


def near_clone_pairs(units: DataFrame, threshold: float = 0.85, length_ratio: float = 0.8) -> DataFrame:
    """left, right, shared, score for all pairs of units (key, n, grams) whose grams have this Jaccard similarity or more.

    No pair is lost; see clone_candidates() for what is compared. Of candidates, only grams that several units have move. n: token
    counts, compared by length_ratio. Units with equal sets should be one unit (see curation.leakage_edges). Units without
    grams pair with none.
    """
    # stored first: a filter would be pushed below what makes the grams
    return stored_clone_pairs(stored(units.select("key", "n", "grams"), "units"), threshold, length_ratio)


def stored_clone_pairs(units: DataFrame, threshold: float = 0.85, length_ratio: float = 0.8) -> DataFrame:
    """near_clone_pairs() of units that are rows of a stored table."""
    pairs, sets = clone_candidates(units.filter(F.size("grams") > 0), threshold, length_ratio)
    x, y = sets.select(F.col("key").alias("left"), F.col("grams").alias("ga")), sets.select(F.col("key").alias("right"), F.col("grams").alias("gb"))
    shared = F.size(F.array_intersect("ga", "gb"))
    both = pairs.join(x, "left").join(y, "right").select("left", "right", "ma", "mb", shared.alias("shared"))
    scored = both.withColumn("score", F.col("shared") / (F.col("ma") + F.col("mb") - F.col("shared"))).filter(F.col("score") >= F.lit(float(threshold)))
    return scored.select("left", "right", F.col("shared").cast("bigint").alias("shared"), rounded(F.col("score"), 4).alias("score"))


def contained_passages(docs: DataFrame, passages: DataFrame, anchor: int = 8) -> DataFrame:
    """doc_id, item_id where the document's text holds the passage's whole text, from a word's start on.

    docs (doc_id, text) and passages (item_id, text) meet by the passage's first words, `anchor` - 1 at most and not the
    last one, which may be the beginning of a longer word; a passage of one word meets the beginnings of that length of the
    document's words. Then the text is searched. Passages without words are held by nothing. One scan of docs makes the
    runs of all the lengths that passages have, at most `anchor` - 1 of words and as many as one-word passages have lengths.
    """
    from lumenweir.functions.text import words

    p = passages.select("item_id", F.col("text").alias("passage"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    k = F.least(F.size("w"), F.lit(anchor)) - 1
    # lengths: words of an anchor, or minus the characters of a one-word passage
    p = p.withColumn("k", F.when(k > 0, k).otherwise(-F.length(F.col("w")[0])))
    p = p.withColumn("h", F.when(F.col("k") > 0, F.xxhash64(F.array_join(F.slice("w", F.lit(1), F.greatest(F.col("k"), F.lit(1))), " "))).otherwise(F.xxhash64(F.col("w")[0])))
    p = stored(p.drop("w"), "passages")
    lengths = [r.k for r in p.select("k").distinct().orderBy("k").collect()]
    d = docs.select("doc_id", "text", words(F.col("text")).alias("w"))
    if not lengths:
        return d.join(p, F.lit(False)).select("doc_id", "item_id")

    def starts(k: int) -> Column:
        own = runs(F.col("w"), k, " ") if k > 0 else F.transform(F.filter("w", lambda x: F.length(x) >= -k), lambda x: F.xxhash64(F.substring(x, 1, -k)))
        have = F.when(F.size("w") >= max(k, 1), F.array_distinct(own)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(have, lambda h: F.struct(F.lit(k).alias("k"), h.alias("h")))

    each = d.select("doc_id", F.explode(F.concat(*(starts(k) for k in lengths))).alias("x")).select("doc_id", "x.k", "x.h")
    hits = each.join(p, ["k", "h"]).select("doc_id", "item_id", "passage")
    return hits.join(docs.select("doc_id", "text"), "doc_id").filter(F.contains("text", "passage")).select("doc_id", "item_id").distinct()
