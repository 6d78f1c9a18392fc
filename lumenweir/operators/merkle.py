"""Digest trees of any depth over the values of each name, to compare tables without comparing all their rows.

A value's digest is the SHA-256 of it, zeros for a null; equal values are counted first, so copies never crowd a leaf. A leaf
holds the digests that share their first digits, about LEAF of them: a name of n digests gets the depth that this takes, FAN
hex digits a level. So no row holds more than 256 children, or the digests of one leaf, however large a name is, and a name's
root depends on its own values alone. A null name counts as the empty one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweir.sources.tables import dropped, stored

LEAF = 64
FAN = 2
MOST_DEPTH = 7


def value_digests(rows: DataFrame, name: Column, value: Column) -> DataFrame:
    """name, d, n: the digests of each name's values, and how many rows have them."""
    digest = F.coalesce(F.sha2(value, 256), F.lit("0" * 64))
    return rows.select(F.coalesce(name.cast("string"), F.lit("")).alias("name"), digest.alias("d")).groupBy("name", "d").agg(F.count("*").alias("n"))


def depths(digests: DataFrame) -> DataFrame:
    """name, depth: the least depth at which a leaf has LEAF digests on average, or fewer."""
    counts = digests.groupBy("name").agg(F.count("*").alias("k"))
    deep = reduce(lambda c, i: c.when(F.col("k") <= LEAF * 16 ** (FAN * i), i), range(1, MOST_DEPTH), F.when(F.col("k") <= LEAF, 0))
    return counts.select("name", deep.otherwise(MOST_DEPTH).cast("int").alias("depth"))


def _combined(parts: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.collect_list(parts)), ","), 256)


def digest_tree(digests: DataFrame, depth: DataFrame | None = None) -> DataFrame:
    """name, depth, level, prefix, n, sha256, stored: every node, from the leaves (level = depth) to each name's root (level 0).

    A leaf combines "digest:rows" of its digests, a node "prefix:sha256" of its children, in order. `depth`: the depths
    (name, depth) of another tree that this one is to be compared with; names it lacks get their own.
    """
    own = depths(digests)
    if depth is not None:
        own = own.join(depth.select("name", F.col("depth").alias("stated")), "name", "left").select("name", F.coalesce("stated", "depth").alias("depth"))
    own = stored(own, "depths")  # known to be small where names are few, so that the digests of a name aren't brought to one task
    placed = digests.join(own, "name").withColumn("prefix", F.expr(f"substring(d, 1, {FAN} * depth)"))
    leaves = placed.groupBy("name", "depth", "prefix").agg(F.sum("n").alias("n"), _combined(F.concat("d", F.lit(":"), F.col("n").cast("string"))).alias("sha256"))
    leaves = stored(leaves, "leaves")
    deepest = leaves.agg(F.max("depth")).first()[0] or 0
    levels: list[DataFrame] = []
    for level in range(deepest, -1, -1):
        nodes = leaves.filter(F.col("depth") == level)
        if levels:
            up = levels[-1].groupBy("name", "depth", F.substring("prefix", 1, FAN * level).alias("prefix"))
            nodes = nodes.unionByName(up.agg(F.sum("n").alias("n"), _combined(F.concat("prefix", F.lit(":"), "sha256")).alias("sha256")))
        levels.append(stored(nodes.withColumn("level", F.lit(level)), "level"))
    tree = stored(reduce(DataFrame.unionByName, levels).select("name", "depth", "level", "prefix", "n", "sha256"), "digest_tree")
    for t in (own, leaves, *levels):
        dropped(t)
    return tree


def roots(tree: DataFrame) -> DataFrame:
    """name, n, sha256: a manifest."""
    return tree.filter("level = 0").select("name", "n", "sha256")


def differing_leaves(stated: DataFrame, found: DataFrame) -> DataFrame:
    """name, depth, prefix of the leaves that differ, by descent: a level's nodes are compared only below nodes that differ.

    Both trees have the same depths for the names that they share, see digest_tree().
    """
    deepest = max(t.agg(F.max("level")).first()[0] or 0 for t in (stated, found))
    node = ["name", "depth", "prefix"]
    above, out = None, []
    for level in range(deepest + 1):
        pair = [t.filter(F.col("level") == level).select(*node, F.col("sha256").alias(side)) for t, side in ((stated, "a"), (found, "b"))]
        if above is not None:
            up = above.select("name", F.col("prefix").alias("up"))
            pair = [p.withColumn("up", F.substring("prefix", 1, FAN * (level - 1))).join(up, ["name", "up"], "left_semi").drop("up") for p in pair]
        above = stored(pair[0].join(pair[1], node, "full_outer").filter("NOT a <=> b").select(*node), "differing")
        out.append(above.filter(F.col("depth") == level))
        if above.isEmpty():
            break
    return reduce(DataFrame.unionByName, out)


def changed_values(stated: DataFrame, found: DataFrame) -> DataFrame:
    """name, d, stated, found: the digests that two tables (of value_digests()) don't have in equally many rows, and how many.

    Only digests in leaves that differ are compared.
    """
    one = digest_tree(stated)
    leaves = stored(differing_leaves(one, digest_tree(found, one.filter("level = 0").select("name", "depth"))), "leaves")
    deep = stored(leaves.select("name", "depth").distinct(), "depths")  # as in digest_tree()

    def below(digests: DataFrame, side: str) -> DataFrame:
        placed = digests.join(deep, "name").withColumn("prefix", F.expr(f"substring(d, 1, {FAN} * depth)"))
        return placed.join(leaves, ["name", "depth", "prefix"], "left_semi").select("name", "d", F.col("n").alias(side))

    both = below(stated, "stated").join(below(found, "found"), ["name", "d"], "full_outer").fillna(0, ["stated", "found"])
    return both.filter("stated <> found")
