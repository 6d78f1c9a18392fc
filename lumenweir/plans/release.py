"""The three runs end to end: a corpus to a balanced release, a release and answers to training records, predictions to metrics.

Each composes the library's operators into one plan of tables and publishes it with manifests; nothing but counts and
small reports reaches the driver.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweir.functions import identity as I
from lumenweir.functions import reports as R
from lumenweir.functions import text as T
from lumenweir.operators import attempts as A
from lumenweir.operators import curation as C
from lumenweir.operators import formatting as Fm
from lumenweir.operators import manifest as N
from lumenweir.operators import metrics as M
from lumenweir.sources.stages import Stages
from lumenweir.sources.tables import stored


@dataclass(frozen=True)
class ReleaseConfig:
    """What a release leaves out, groups, splits and balances by."""

    excluded_origins: tuple[str, ...] = ()
    leak_text: str | None = None
    most_tokens: int = 4096
    min_tokens: int = 100
    jaccard: float = 0.85
    length_ratio: float = 0.8
    folds: int = 8
    test_folds: tuple[int, ...] = (0, 1)
    validation_folds: tuple[int, ...] = (2,)
    seed: int = 42
    #: First and last seed of a split search, and the groups of each label that train, validation and test need; empty: groups are dealt by their hash.
    split_seeds: tuple[int, ...] = ()
    least_groups: tuple[int, ...] = (1, 1, 1)


@dataclass
class Release:
    """rows: selected rows with partition and match; exclusions: path, collection, label, reason; groups; statistics; and of a
    split search split_attempts: seed, partition, label, groups, collections, least_rows, passed (before balancing), chosen."""

    rows: DataFrame
    exclusions: DataFrame
    edges: DataFrame
    statistics: DataFrame
    names: list[str] = field(default_factory=lambda: ["rows", "exclusions", "edges", "statistics"])
    split_attempts: DataFrame | None = None


def searched_split(rows: DataFrame, config: ReleaseConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with partition, their match roles, attempts) of the first seed whose partitions pass the gates when balanced.

    What balancing leaves of a partition passes only if the whole of it does, so only such seeds are balanced, in order.
    """
    least = dict(zip(("train", "validation", "test"), config.least_groups, strict=True))
    first, last = config.split_seeds
    placed, attempts = C.seed_attempts(rows, config.folds, range(first, last + 1), least, test=config.test_folds, validation=config.validation_folds)
    collections = rows.select("collection").distinct().count()
    whole = attempts.filter("passed").groupBy("seed").agg(F.count("*").alias("n")).filter(F.col("n") == 2 * len(least))
    for seed in [r.seed for r in whole.orderBy("seed").collect()]:
        out = stored(rows.join(placed.filter(F.col("seed") == seed).select("group_id", "partition"), "group_id"), "rows")
        match = stored(C.match_roles(out, stored(C.balanced_ranks(out, config.seed), "pairs")), "match")
        selected = out.join(match.filter("match_role <> 'surplus'").select("query_id"), "query_id", "left_semi")
        passed = {r.partition: r.passed for r in C.gates(selected, least, collections).collect()}
        if all(passed.get(p) for p in least):
            return out, match, attempts.withColumn("chosen", F.col("seed") == seed)
    raise ValueError(f"no seed from {first} to {last} passes the gates")


def build_release(corpus: DataFrame, config: ReleaseConfig = ReleaseConfig(), tokens: Column | None = None) -> Release:
    """corpus: path bigint, collection, label, origin, content (null if unreadable).

    Rows are excluded in order of cost, named by their code tokens, reduced to one of each identity, grouped by families,
    skeletons and near clones, dealt to partitions by their group, and balanced one to one within partition and collection.
    """
    code = T.strip_comments(F.col("content"))
    read = corpus.select("path", "collection", "label", "origin", "content", code.alias("code"))
    read = read.select("*", (T.code_tokens(F.col("content")) if tokens is None else tokens).alias("tokens"), T.extracted(F.col("content"), r"pragma\s+solidity[^;]*?(\d+\.\d+)").alias("version"))
    rules = [
        ("excluded_origin", F.col("origin").isin(*config.excluded_origins) if config.excluded_origins else F.lit(False)),
        ("unreadable_source", F.col("content").isNull() | F.col("code").isNull() | F.col("tokens").isNull() | (F.size("tokens") == 0)),
        ("label_leaking_identifiers", F.contains("content", F.lit(config.leak_text)) if config.leak_text else F.lit(False)),
        ("overlength_source", F.size("tokens") > config.most_tokens),
    ]
    judged = stored(C.with_reason(read, rules).withColumn("identity", I.code_identity(F.col("tokens"))), "judged")
    usable = C.exact_duplicates(judged.filter("reason IS NULL").drop("reason"))
    usable = stored(usable.withColumn("skeleton", I.list_digest(T.skeleton(F.col("tokens")))), "usable")
    kept = usable.filter("reason IS NULL")
    units = kept.select(F.col("path").alias("key"), "skeleton", "tokens", F.lit(None).cast("string").alias("family"))
    edges = stored(C.leakage_edges(units, config.min_tokens, config.jaccard, config.length_ratio), "edges")
    groups = C.grouped(units, edges)
    part = C.hash_partition(F.col("group_id"), config.folds, config.test_folds, config.validation_folds)
    rows = kept.join(groups.select(F.col("key").alias("path"), "group_id"), "path").withColumn("query_id", F.col("path"))
    rows = rows.select("query_id", "collection", "label", "version", "group_id", "identity", F.size("tokens").cast("bigint").alias("source_tokens"), T.numbered(F.col("code")).alias("source"))
    attempts = None
    if config.split_seeds:
        rows, match, attempts = searched_split(stored(rows, "ungrouped"), config)
    else:
        rows = stored(rows.withColumn("partition", part), "rows")
        match = stored(C.match_roles(rows, stored(C.balanced_ranks(rows, config.seed), "pairs")), "match")
    selected = rows.join(match.filter("match_role <> 'surplus'"), "query_id")
    surplus = rows.join(match.filter("match_role = 'surplus'"), "query_id", "left_semi")
    ledger = (
        judged.filter("reason IS NOT NULL").select("path", "collection", "label", "reason")
        .unionByName(usable.filter("reason IS NOT NULL").select("path", "collection", "label", "reason"))
        .unionByName(surplus.select(F.col("query_id").alias("path"), "collection", "label", F.lit("surplus").alias("reason")))
    )
    out = Release(selected, ledger, edges, C.split_cells(selected), split_attempts=attempts)
    if attempts is not None:
        out.names.append("split_attempts")
    return out


def staged_release(spark, folder: str, corpus: DataFrame, config: ReleaseConfig = ReleaseConfig()) -> dict[str, DataFrame]:
    """The tables of build_release() in a folder of the run's own: built once, read on a rerun, and refused for another
    corpus or configuration."""
    stages = Stages(spark, folder, asdict(config), {"corpus": corpus})

    def build() -> dict[str, DataFrame]:
        out = build_release(corpus, config)
        return {name: getattr(out, name) for name in out.names}

    return stages.stage("release", build)


def build_training_records(rows: DataFrame, log: DataFrame, systems: dict[str, str], most_tokens: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(records, exclusions) of the train partition: rows of a release with a match, and a log (query_id, seq, status, report).

    The last answer of each row counts and every row needs one; a pair stays only if both answers are accepted and short
    enough under every condition. Records are in one seeded order, by (order, task_rank).
    """
    train = rows.filter("partition = 'train'")
    last = A.latest(log, "query_id", "seq").select("query_id", "status", "report")
    train = stored(train.join(last, "query_id", "left").withColumn("status", F.coalesce("status", F.lit("missing"))), "train")
    targets = {"label": F.col("label"), "report": R.canonical_report(F.col("report")), "report_vf": R.canonical_report(F.col("report"), "verdict_first")}
    each = Fm.by_condition(train.filter("status = 'accepted'"), systems, {c: targets[c] for c in systems})
    each = each.select(F.col("query_id").alias("id"), "label", "collection", "group_id", "condition", Fm.messages(F.col("system"), F.col("source")).alias("prompt"), F.array(F.struct(F.lit("assistant").alias("role"), F.col("target").alias("content"))).alias("completion"))
    each = stored(Fm.with_token_counts(each, lambda t: F.size(T.word_tokens(t))), "records")
    long = Fm.too_long(each, most_tokens).select(F.col("id").alias("query_id"), F.lit(True).alias("too_long"))
    state = train.select("query_id", "status").join(long, "query_id", "left").withColumn("too_long", F.coalesce("too_long", F.lit(False)))
    pairs = train.filter("match_role = 'case'").select(F.col("query_id").alias("left"), F.col("match_partner").alias("right"))
    fate = stored(C.pair_removal(pairs, state), "fate")
    kept = each.join(fate.filter("reason IS NULL").select(F.col("query_id").alias("id")), "id", "left_semi")
    return Fm.interleaved(kept, tuple(systems), seed), fate.filter("reason IS NOT NULL")


def evaluate(predictions: DataFrame, gold: DataFrame, comparisons: list[tuple[str, str]] | None = None, draws: int = 20_000, replicates: int = 2000) -> dict[str, DataFrame]:
    """scores, by_collection, intervals of long predictions (mode, id, predicted) against gold (id, gold, collection, group_id).

    Every mode must cover the gold ids exactly; otherwise it is an error.
    """
    modes = sorted(r.mode for r in predictions.select("mode").distinct().collect())  # a handful
    wanted = gold.select(F.explode(F.array(*map(F.lit, modes))).alias("mode"), "id")
    key = lambda df: df.select(F.concat_ws(":", "mode", F.col("id").cast("string")).alias("k"))
    gap = N.coverage(key(wanted), key(predictions), "k").collect()[0]
    if gap.missing or gap.unexpected:
        raise ValueError(f"predictions miss {gap.missing} rows and have {gap.unexpected} that gold has not")
    both = stored(predictions.join(gold, "id"), "predictions")
    return {"scores": M.scores(both, "mode"), "by_collection": M.scores_with_total(both), "intervals": M.bootstrap(both, draws, "4242", comparisons, replicates)}
