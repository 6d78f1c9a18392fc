"""Exclusion ledgers, exact duplicates with label conflicts, leakage groups, splits, balancing and sampling."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce
from heapq import heappop, heappush, heapreplace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenweir.functions.identity import group_id, seeded
from lumenweir.operators.components import components
from lumenweir.operators.ranks import parts_for, prefix_sums
from lumenweir.operators.similarity import near_clone_pairs, shingles, without_keys
from lumenweir.sources.tables import dropped, stored

LABELS = ("PRESENT", "ABSENT")


def with_reason(rows: DataFrame, rules: list[tuple[str, Column]], name: str = "reason") -> DataFrame:
    """The first rule that holds gives the reason; null where none does. Rules are given cheapest first."""
    return rows.withColumn(name, F.coalesce(*(F.when(rule, F.lit(reason)) for reason, rule in rules)))


def exact_duplicates(rows: DataFrame) -> DataFrame:
    """rows (identity, path, label, ...) with reason: null for the kept row, `duplicate`, or `conflicting_duplicate`.

    The least path of an identity is kept, unless its copies disagree on the label; then none is. Labels and paths are
    combined on the map side and join back, so an identity with many copies is no hot window.
    """
    about = stored(rows.groupBy("identity").agg(F.min("path").alias("_keep"), (F.min("label") != F.max("label")).alias("_conflict")), "identities")
    both = rows.join(about, "identity")
    reason = F.when(F.col("_conflict"), "conflicting_duplicate").when(F.col("path") != F.col("_keep"), "duplicate")
    return both.withColumn("reason", reason).drop("_keep", "_conflict")


def families(rows: DataFrame, of: Column) -> DataFrame:
    """identity, path (the least), families: the distinct origins of all copies for which `of` holds, in order."""
    return rows.groupBy("identity").agg(F.min("path").alias("path"), F.array_sort(F.collect_set(F.when(of, F.col("origin")))).alias("families"))


def first_seen_edges(rows: DataFrame, key: str, value: str, reason: str) -> DataFrame:
    """left, right, reason: each row linked to the first row of its value, by the least key."""
    first = stored(rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.min(key).alias("left")), "first")
    return rows.join(first, value).filter(F.col("left") < F.col(key)).select("left", F.col(key).alias("right"), F.lit(reason).alias("reason")).distinct()


def leakage_edges(rows: DataFrame, min_tokens: int = 100, threshold: float = 0.85, length_ratio: float = 0.8) -> DataFrame:
    """left, right, reason, score: declared families, exact skeletons, and near clones between skeletons' first rows.

    rows: key bigint, skeleton string (its digest), tokens array<string>, family string or null. Near clones are sought
    among one row of each skeleton, since equal skeletons are linked anyhow.
    """
    edges = first_seen_edges(rows, "key", "family", "declared_family").unionByName(first_seen_edges(rows, "key", "skeleton", "exact_skeleton")).withColumn("score", F.lit(None).cast("double"))
    long = rows.filter(F.size("tokens") >= min_tokens)
    thin = long.select("key", "skeleton")
    first = stored(thin.groupBy("skeleton").agg(F.min("key").alias("first"), F.count("*").alias("rows")).filter("rows > 1").drop("rows"), "first_long")
    later = stored(thin.join(first, "skeleton").filter("key > first").select("key"), "later")
    one = without_keys(long, later)
    if not thin.groupBy("key").count().filter("count > 1").isEmpty():  # a key given twice is one unit
        one = one.dropDuplicates(["key"])
    units = one.select("key", F.size("tokens").alias("n"), shingles(F.col("tokens")).alias("grams"))
    near = near_clone_pairs(units, threshold, length_ratio)
    return edges.unionByName(near.select("left", "right", F.lit("near_clone").alias("reason"), "score"))


def grouped(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """key, root (the least key of its group), group_id (digest of the members), members: one row for each row's key."""
    label = components(edges.select(F.col("left").alias("a"), F.col("right").alias("b")))
    of = rows.select("key").distinct().join(label, F.col("key") == F.col("node"), "left").select("key", F.coalesce("label", "key").alias("root"))
    of = stored(of, "roots")
    names = of.groupBy("root").agg(group_id(F.collect_list(F.col("key").cast("string"))).alias("group_id"), F.count("*").alias("members"))
    return of.join(stored(names, "groups"), "root").select("key", "root", "group_id", "members")


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The edges (left, right, reason, ...) that join two parts when all are taken in order of (reason rank, left, right).

    These are the edges of the least spanning forest in that order, whatever the order in which they are found: in each round
    every part takes its least edge to another part, as a partial aggregate, and parts that an edge joins become one. There
    are at most log2(nodes) rounds, and edges within a part leave the table. Repeated edges and self-loops are allowed.
    """
    rank = F.when(F.col("reason") == "declared_family", 0).when(F.col("reason") == "exact_skeleton", 1).otherwise(2)
    edge = F.struct(rank.alias("rank"), "left", "right", "reason").alias("e")
    rows = stored(edges.filter("left != right").select(edge, F.col("left").alias("a"), F.col("right").alias("b")).distinct(), "forest_edges")
    taken: list[DataFrame] = []
    while not rows.isEmpty():
        ends = rows.select("e", F.explode(F.array(F.struct(F.col("a").alias("part"), F.col("b").alias("other")), F.struct(F.col("b").alias("part"), F.col("a").alias("other")))).alias("x"))
        least = ends.groupBy("x.part").agg(F.min(F.struct("e", "x.other")).alias("least")).select("part", "least.e", "least.other")
        least = stored(least, "least_edges")
        taken.append(least.select("e.left", "e.right", "e.reason").distinct())
        whole = stored(components(least.select(F.col("part").alias("a"), F.col("other").alias("b"))), "parts")
        merged = rows
        for end in "ab":  # every part has an edge, so it has a label
            merged = merged.join(whole.withColumnRenamed("node", end).withColumnRenamed("label", f"new_{end}"), end)
        merged = stored(merged.filter("new_a != new_b").select("e", F.col("new_a").alias("a"), F.col("new_b").alias("b")), "forest_edges")
        for t in (rows, whole):
            dropped(t)
        rows = merged
    kept = reduce(DataFrame.unionByName, taken) if taken else edges.limit(0).select("left", "right", "reason")
    return edges.dropDuplicates(["left", "right", "reason"]).join(kept.distinct(), ["left", "right", "reason"], "left_semi")


def hash_partition(key: Column, folds: int = 8, test: tuple[int, ...] = (0, 1), validation: tuple[int, ...] = (2,), salt: str = "") -> Column:
    """train, validation or test by the group's hash: no group crosses partitions, and new rows never move old ones."""
    fold = F.pmod(F.conv(F.substring(F.sha2(F.concat(F.lit(salt), key), 256), 1, 8), 16, 10).cast("bigint"), F.lit(folds))
    return F.when(fold.isin(*test), "test").when(fold.isin(*validation), "validation").otherwise("train")


def split_cells(rows: DataFrame) -> DataFrame:
    """partition, collection, label, n (0 for a missing label), groups: rows and distinct groups of each cell."""
    cells = rows.groupBy("partition", "collection", "label").agg(F.count("*").alias("n"), F.countDistinct("group_id").alias("groups"))
    every = rows.select("partition", "collection").distinct().withColumn("label", F.explode(F.array(*map(F.lit, LABELS))))
    return every.join(cells, ["partition", "collection", "label"], "left").select("partition", "collection", "label", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("groups", F.lit(0)).alias("groups"))


def gates(rows: DataFrame, least: dict[str, int], collections: int) -> DataFrame:
    """partition, passed: groups of each label reach the gate, every collection is there, and every cell has rows."""
    cells = split_cells(rows).groupBy("partition").agg(F.countDistinct("collection").alias("c"), F.min("n").alias("n"))
    groups = rows.groupBy("partition", "label").agg(F.countDistinct("group_id").alias("g")).groupBy("partition").agg(F.min("g").alias("g"), F.count("*").alias("k"))
    gate = reduce(lambda w, x: w.when(F.col("partition") == x[0], F.lit(x[1])), least.items(), F.when(F.lit(False), F.lit(0)))
    return cells.join(groups, "partition").select("partition", ((F.col("c") == collections) & (F.col("n") > 0) & (F.col("k") == len(LABELS)) & (F.col("g") >= gate)).alias("passed"))


def fold_groups(cells: DataFrame, folds: int, seeds: Iterable[int]) -> DataFrame:
    """seed, group_id, fold for each seed and group of cells (group_id, stratum, n: its rows in a stratum).

    A group counts for the stratum that most of its rows are in (the first of those by name). A stratum's groups stand in the
    order of SHA-256 of "seed:group_id", end to end by their rows, and the line is cut into even folds; a group goes to the
    fold that its middle lies in. So in each fold a stratum has its share of rows but for one group at most. Prefix sums
    are taken in parts of the hash order, so that no task holds a stratum.
    """
    own = cells.groupBy("group_id").agg(F.max(F.struct("n", F.struct("stratum"))).alias("most"), F.sum("n").alias("rows"), F.collect_list(F.struct("n", "stratum")).alias("all"))
    first = F.array_min(F.transform(F.filter("all", lambda x: x["n"] == F.col("most.n")), lambda x: x["stratum"]))
    own = stored(own.select("group_id", first.alias("stratum"), "rows"), "groups")
    each = own.withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    each = each.withColumn("order", F.sha2(F.concat(F.col("seed").cast("string"), F.lit(":"), F.col("group_id").cast("string")), 256))
    parts = parts_for(own.count())
    bucket = F.floor(F.conv(F.substring("order", 1, 7), 16, 10).cast("bigint") * parts / (1 << 28))
    placed = prefix_sums(each, ["seed", "stratum"], bucket, ["order", "group_id"], "rows", "before", "total")
    fold = F.expr(f"(2 * before + rows) * {int(folds)} div (2 * total)")
    return placed.select("seed", "group_id", F.least(fold, F.lit(folds - 1)).cast("int").alias("fold"))


def seed_attempts(rows: DataFrame, folds: int, seeds: Iterable[int], least: dict[str, int], test: tuple[int, ...] = (0, 1), validation: tuple[int, ...] = (2,)) -> tuple[DataFrame, DataFrame]:
    """(placed, attempts), stored: seed, group_id, partition of each group; and seed, partition, label, groups, collections,
    least_rows (of a collection), passed, all seeds in one plan over a row for each group and stratum.

    rows: group_id, collection, label, ...; strata are collection and label, dealt by fold_groups(). A label passes in a partition
    if it has the groups that `least` asks for, and rows of every collection.
    """
    cells = stored(rows.groupBy("group_id", "collection", "label").agg(F.count("*").alias("n")), "strata")
    name = F.when(F.col("fold").isin(*test), "test").when(F.col("fold").isin(*validation), "validation").otherwise("train")
    placed = fold_groups(cells.select("group_id", F.concat_ws("|", "collection", "label").alias("stratum"), "n"), folds, list(seeds))
    placed = stored(placed.select("seed", "group_id", name.alias("partition")), "placed")
    collections = cells.select("collection").distinct().count()
    by, dealt = ["seed", "partition", "label"], cells.join(placed, "group_id")
    strata = dealt.groupBy(*by, "collection").agg(F.sum("n").alias("n")).groupBy(*by).agg(F.count("*").alias("collections"), F.min("n").alias("least_rows"))
    groups = dealt.select(*by, "group_id").distinct().groupBy(*by).agg(F.count("*").alias("groups"))
    gate = F.coalesce(*(F.when(F.col("partition") == p, F.lit(n)) for p, n in least.items()))
    attempts = groups.join(strata, by).withColumn("passed", (F.col("groups") >= gate) & (F.col("collections") == collections))
    return placed, stored(attempts, "attempts")


def stratified_group_split(rows: DataFrame, folds: int, seeds: Iterable[int], least: dict[str, int], **where) -> tuple[DataFrame, int, DataFrame]:
    """rows with partition, the first seed that passes the gates in every partition and label, and the attempts of all seeds.

    See seed_attempts(). If no seed passes, that is an error.
    """
    placed, attempts = seed_attempts(rows, folds, seeds, least, **where)
    good = attempts.filter("passed").groupBy("seed").agg(F.count("*").alias("n")).filter(F.col("n") == len(least) * len(LABELS)).agg(F.min("seed")).first()[0]
    if good is None:
        raise ValueError("no seed passes the gates")
    return rows.join(placed.filter(F.col("seed") == good).select("group_id", "partition"), "group_id"), good, attempts


def balanced_ranks(rows: DataFrame, seed: int) -> DataFrame:
    """One-to-one matching by sets: within a cell and version the k-th case takes the k-th control, in seeded order; what is
    left over is matched the same way within the cell. Gives case, control, match_level; controls without case are surplus.

    rows: query_id, partition, collection, label, version. Cases are the rarer label of a cell, ABSENT on a tie.
    """
    cell = ["partition", "collection"]
    counts = rows.groupBy(*cell).agg(F.count_if(F.col("label") == "PRESENT").alias("p"), F.count_if(F.col("label") == "ABSENT").alias("a"))
    minority = F.when(F.col("p") < F.col("a"), "PRESENT").otherwise("ABSENT")
    rows = stored(rows.join(counts.select(*cell, minority.alias("minority")), cell).withColumn("case", F.col("label") == F.col("minority")).withColumn("order", seeded(seed, F.col("query_id"))), "cells")

    def match(df: DataFrame, by: list[str], level: int) -> DataFrame:
        ranked = df.withColumn("k", F.row_number().over(Window.partitionBy(*by, "case").orderBy("order")))
        cases, controls = ranked.filter("case"), ranked.filter("NOT case")
        pick = [*by, "k"]
        return cases.select(*pick, *(c for c in cell if c not in by), F.col("query_id").alias("case_id")).join(controls.select(*pick, F.col("query_id").alias("control_id")), pick).select(*cell, "case_id", "control_id", F.lit(level).cast("bigint").alias("match_level"))

    one = stored(match(rows, [*cell, "version"], 0), "matched")
    used = one.select(F.explode(F.array("case_id", "control_id")).alias("query_id"))
    return one.unionByName(match(rows.join(used, "query_id", "left_anti"), cell, 1))


def match_roles(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """query_id, match_role (case, control, surplus), match_partner, match_level: rows of cells with the pairs of balanced_ranks();
    the common label's rows without a partner are surplus."""
    case = pairs.select(F.col("case_id").alias("query_id"), F.lit("case").alias("match_role"), F.col("control_id").alias("match_partner"), "match_level")
    control = pairs.select(F.col("control_id").alias("query_id"), F.lit("control").alias("match_role"), F.col("case_id").alias("match_partner"), "match_level")
    out = rows.select("query_id").join(case.unionByName(control), "query_id", "left")
    return out.withColumn("match_role", F.coalesce("match_role", F.lit("surplus")))


def balanced_greedy(rows: DataFrame, levels: list[list[str]], seed: int) -> DataFrame:
    """One-to-one matching as a sequence: levels in order, cases in seeded order; of the free controls that agree with the case
    on the level's fields the one whose group was used least goes, then by seeded order. One task for each cell, so for
    cells that fit one; balanced_ranks() is for any size.

    Gives partition, collection, query_id, match_role (case, control, surplus), match_partner, match_level. A level's
    controls wait in one heap for each value of its fields; an entry whose group was used since it was pushed goes back.
    """
    fields = sorted({f for level in levels for f in level})

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        order = pdf.sort_values("order")
        tally = order["label"].value_counts()
        is_case = order["label"] == ("PRESENT" if tally.get("PRESENT", 0) < tally.get("ABSENT", 0) else "ABSENT")
        group, query = order["group_id"].tolist(), order["query_id"].tolist()
        waiting, left = np.flatnonzero(is_case).tolist(), set(np.flatnonzero(~is_case).tolist())
        used: Counter = Counter()
        out = []
        for depth, level in enumerate(levels):
            value = list(order[level].itertuples(index=False, name=None)) if level else [()] * len(order)
            heaps: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
            for j in sorted(left):
                heappush(heaps[value[j]], (used[group[j]], j))
            unmet = []
            for i in waiting:
                heap = heaps[value[i]]
                while heap and heap[0][0] != used[group[heap[0][1]]]:
                    heapreplace(heap, (used[group[heap[0][1]]], heap[0][1]))
                if not heap:
                    unmet.append(i)
                    continue
                j = heappop(heap)[1]
                used[group[j]] += 1
                left.remove(j)
                out += [(query[i], "case", query[j], depth), (query[j], "control", query[i], depth)]
            waiting = unmet
        out += [(query[j], "surplus", None, None) for j in sorted(left)]
        got = pd.DataFrame(out, columns=["query_id", "match_role", "match_partner", "match_level"])
        got.insert(0, "collection", order["collection"].iloc[0])
        got.insert(0, "partition", order["partition"].iloc[0])
        return got.astype({"match_level": "Int64"})

    kind = rows.schema["query_id"].dataType.simpleString()
    cols = list(dict.fromkeys(["partition", "collection", "query_id", "label", "group_id", *fields]))
    return rows.select(*cols, seeded(seed, F.col("query_id")).alias("order")).groupBy("partition", "collection").applyInPandas(cell, f"partition string, collection string, query_id {kind}, match_role string, match_partner {kind}, match_level bigint")


def pair_removal(pairs: DataFrame, status: DataFrame) -> DataFrame:
    """query_id, reason (null: kept) for both members of each pair (left, right): a pair stays only if both are accepted and
    short enough; the healthy member of a broken pair is `partner_removed`. status: query_id, status, too_long; a member that
    has no row or no status there is `teacher_missing`, so no pair is lost."""
    fine = F.col("status").eqNullSafe("accepted")
    own = F.when(~fine, F.concat(F.lit("teacher_"), F.coalesce("status", F.lit("missing")))).when(F.col("too_long"), "overlength_sequence").otherwise("")
    s = status.select("query_id", own.alias("own"))
    a, b = s.select(F.col("query_id").alias("left"), F.col("own").alias("l")), s.select(F.col("query_id").alias("right"), F.col("own").alias("r"))
    both = pairs.select("left", "right").join(a, on="left", how="left").join(b, on="right", how="left")
    both = both.select("left", "right", *(F.nullif(F.coalesce(c, F.lit("teacher_missing")), F.lit("")).alias(c) for c in "lr"))
    fate = lambda mine, other: F.when(mine.isNotNull() | other.isNotNull(), F.coalesce(mine, F.lit("partner_removed")))
    return both.select(F.explode(F.array(F.struct(F.col("left").alias("query_id"), fate(F.col("l"), F.col("r")).alias("reason")), F.struct(F.col("right").alias("query_id"), fate(F.col("r"), F.col("l")).alias("reason")))).alias("x")).select("x.*")


def pilot_sample(rows: DataFrame, per_label: int, seed: int) -> DataFrame:
    """A few rows of each label in the order sha256("seed:id"): first from collections not taken yet, then from any, never two
    of one group. The rule is sequential; before it, all that it could ever take is kept: the first rows of each label,
    collection and group in order, few for each collection."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("query_id").cast("string")), 256)
    rows = rows.select("query_id", "label", "collection", "group_id").withColumn("order", order)
    first = rows.groupBy("label", "collection", "group_id").agg(F.min(F.struct("order", "query_id")).alias("f")).select("label", "collection", "group_id", "f.*")
    # at most 2 * per_label groups can be taken, so no more rows of a label and collection are ever looked at
    rank = F.row_number().over(Window.partitionBy("label", "collection").orderBy("order"))
    few = first.withColumn("r", rank).filter(F.col("r") <= 2 * per_label + 1)

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        table = pd.concat(held).sort_values("order")
        taken = table.iloc[:0]
        for label in LABELS:
            own, had = table[table["label"] == label], taken
            # what bars a row only grows, so the first row that nothing bars is the next one in order
            for bars in (("collection", "group_id"), ("group_id",)):
                while len(taken) - len(had) < per_label:
                    ours = taken[taken["label"] == label]
                    free = ~own["group_id"].isin(taken["group_id"])
                    if "collection" in bars:
                        free &= ~own["collection"].isin(ours["collection"])
                    if not free.any():
                        break
                    taken = pd.concat([taken, own[free].head(1)])
        yield taken[["query_id", "label", "collection", "group_id"]]

    kind = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("query_id", "label", "collection", "group_id"))
    return few.coalesce(1).mapInPandas(pick, kind)


def cohort_gate(rows: DataFrame, least: int) -> DataFrame:
    """label, groups, passed for both labels: distinct groups that are left, against the gate; a label without rows fails."""
    groups = rows.groupBy("label").agg(F.countDistinct("group_id").alias("groups"))
    every = rows.sparkSession.createDataFrame([(v,) for v in LABELS], "label string")
    out = F.broadcast(every).join(groups, "label", "left").select("label", F.coalesce("groups", F.lit(0)).alias("groups"))
    return out.withColumn("passed", F.col("groups") >= least)


def first_occurrences(rows: DataFrame, value: str, position: str) -> DataFrame:
    """value, position of its first occurrence; sorted by position these are the distinct values in order of appearance."""
    return rows.groupBy(value).agg(F.min(position).alias(position))
