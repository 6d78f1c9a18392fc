"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions alone.

A source of share p among `period` slots may run its k-th block from slot floor(k * period / p) on and must have run it by
slot ceil((k + 1) * period / p). The earliest deadline first among the released blocks meets every deadline, so after any
slot each source is less than one block from its weight. All windows repeat after `period` slots, so one period is
scheduled, whatever the corpus, and every block's slot follows from its number.

A schedule is made in one row, so it takes MOST_SOURCES sources. Of more, the small ones share lanes, which are scheduled
like sources, each with a schedule of its own inside; lanes too many for a schedule share lanes again. A source that
shares a lane is less than two blocks from its weight, as its lane is less than one block from the lane's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenweir.llm.common import documents, stored
from lumenweir.operators.ranks import parts_for, ranked

BLOCK_ROWS = 32
#: Slots of a period, at least. Every source has one, so each further source adds SOURCE_SLOTS, of which that one is little.
PERIOD = 1000
SOURCE_SLOTS = 40
#: Sources of one schedule, and how many share a lane where there are more.
MOST_SOURCES = 500
LANE_SOURCES = 128
#: Without given targets, a source's weight is its rows to this power, which raises small sources a little.
POWER = 0.9


def source_key(source: Column) -> Column:
    """Null is a source of its own, apart from the empty name."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def sizes_of(docs: DataFrame, targets: dict[str, float] | None = None, power: float = POWER) -> DataFrame:
    """key, n, w: the rows and the weight of each source; without targets n to the power, with them 0 for sources not named."""
    sizes = docs.groupBy(source_key(F.col("source")).alias("key")).agg(F.count("*").alias("n"))
    if targets is None:
        return sizes.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(power)))
    of = F.create_map(*(x for k, w in targets.items() for x in (F.lit("=" + k), F.lit(float(w))))) if targets else F.create_map()
    return sizes.withColumn("w", F.coalesce(F.try_element_at(of, F.col("key")), F.lit(0.0)))


def shares(docs: DataFrame, targets: dict[str, float] | None = None, period: int = PERIOD, power: float = POWER) -> DataFrame:
    """One row: the sources of docs with their shares, as apportioned() gives them."""
    return apportioned(sizes_of(docs, targets, power), period)


def apportioned(sizes: DataFrame, period: int | Column, *by: str) -> DataFrame:
    """A row for each value of `by`, or one: sources array<struct<key, n, p>> by key. Shares p are whole slots of the period, at least one each, by largest remainder.

    Sources without weight still get one slot of the period.
    """
    period = F.lit(period)
    one = sizes.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("key", "n", "w"))).alias("s"))
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + x["w"])
    one = one.withColumn("total", F.greatest(total, F.lit(1e-300))).withColumn("free", period - F.size("s"))
    exact = lambda x: x["w"] / F.col("total") * F.col("free")
    one = one.withColumn("s", F.transform("s", lambda x: F.struct(x["key"], x["n"], F.floor(exact(x)).alias("whole"), (exact(x) - F.floor(exact(x))).alias("rest"))))
    one = one.withColumn("spare", F.col("free") - F.aggregate("s", F.lit(0).cast("bigint"), lambda a, x: a + x["whole"]))
    one = one.withColumn("by", F.array_sort(F.transform("s", lambda x: F.struct((-x["rest"]).alias("r"), x["key"].alias("key")))))
    place = lambda x: F.array_position(F.transform("by", lambda y: y["key"]), x["key"])
    # all weights 0: the spare slots exceed the sources and go round
    more = lambda x: F.floor((F.col("spare") + F.size("s") - place(x)) / F.size("s"))
    p = lambda x: (1 + x["whole"] + more(x)).cast("bigint")
    return one.select(*by, F.transform("s", lambda x: F.struct(x["key"].alias("key"), x["n"].alias("n"), p(x).alias("p"))).alias("sources"))


def stop_of(sources: Column, period: Column, block_rows: int) -> Column:
    """The first slot at which some source has no block left."""
    return F.array_min(F.transform(sources, lambda x: F.floor(F.ceil(x["n"] / F.lit(block_rows)) * period / x["p"])))


def schedule(one: DataFrame, period: int | Column = PERIOD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """key, n, p, k, t, stop: the slot t of a period in which the source's k-th block of the period runs; `period` rows for each of `one`."""
    q = F.lit(period).cast("bigint")
    never = F.lit(1 << 60)
    src = F.col("sources")

    def step(state: Column, t: Column) -> Column:
        window = F.zip_with(
            src,
            state["k"],
            lambda x, k: F.when(F.expr("true") & (k < x["p"]) & (F.floor(k * q / x["p"]) <= t), F.ceil((k + 1) * q / x["p"])).otherwise(never),
        )
        # window and first are bound as the items of arrays, so that each is evaluated once a slot and not once a source
        first = F.transform(F.array(window), lambda w: F.array_position(w, F.array_min(w)).cast("int"))
        after = F.transform(
            first,
            lambda f: F.struct(
                F.transform(state["k"], lambda k, i: F.when(i == f - 1, k + 1).otherwise(k)).alias("k"),
                F.concat(state["run"], F.array(f)).alias("run"),
            ),
        )
        return F.element_at(after, 1)

    start = F.struct(F.transform(src, lambda _: F.lit(0).cast("bigint")).alias("k"), F.array().cast("array<int>").alias("run"))
    run = F.aggregate(F.sequence(F.lit(0).cast("bigint"), q - 1), start, step, lambda s: s["run"])
    slots = one.filter(F.size("sources") > 0).withColumn("stop", stop_of(src, q, block_rows)).select("sources", "stop", F.posexplode(run).alias("t", "i"))
    slots = slots.select(F.col("t").cast("bigint").alias("t"), "stop", F.element_at("sources", F.col("i")).alias("s")).select("t", "stop", "s.*")
    order = Window.partitionBy("key").orderBy("t")
    return slots.withColumn("k", (F.row_number().over(order) - 1).cast("bigint"))


def spread(doc_id: Column) -> Column:
    """A fixed pseudo-random order of the rows of a source: the first 60 bits of the MD5 of the id."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint")


def laned(sizes: DataFrame, count: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Deal the sources of small weight to lanes: plan (lane, key, p, k, t, period), a schedule for each lane; and the sizes
    (key, n, w) of the next schedule, whose sources are the lanes and the sources left alone.

    n of a lane is what its sources hold up to the lane's first slot without a block.
    """
    lanes = -(-count // LANE_SOURCES)
    total = sizes.agg(F.sum("w")).first()[0]
    alone = F.col("w") > F.lit(total / lanes)
    lane = F.concat(F.lit("lane "), F.pmod(F.xxhash64("key"), F.lit(lanes)).cast("string"), F.lit("/"), F.lit(str(count)))
    small = sizes.filter(~alone).withColumn("lane", lane)
    one = apportioned(small.withColumn("period", F.count("*").over(Window.partitionBy("lane")) * SOURCE_SLOTS), F.col("period"), "lane", "period")
    one = stored(one, "lanes")
    weight = small.groupBy("lane").agg(F.sum("w").alias("w"))
    whole = one.select("lane", (stop_of(F.col("sources"), F.col("period"), block_rows) * block_rows).alias("n"))
    after = sizes.filter(alone).unionByName(whole.join(weight, "lane").withColumnRenamed("lane", "key"))
    plan = schedule(one.repartition(lanes, "lane"), F.col("period"), block_rows)
    of = one.select("lane", "period", F.explode("sources.key").alias("key"))
    return plan.select("key", "p", "k", "t").join(of, "key"), after


def mixed(docs: DataFrame, targets: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS, period: int | None = None, power: float = POWER) -> DataFrame:
    """The rows of docs with a column mix: struct<share, block, release, deadline, slot, place, on_target>.

    Sorted by (mix.slot, mix.place) the rows are the mix. on_target is true up to the first slot at which some source has
    no block left: up to there every source is less than one block from its weight; later rows are still given a slot, so
    no row is lost. Rows of a source follow the MD5 of their doc_id, then doc_id. Null sources form a source; null doc_ids
    sort together; repeated rows take places of their own; an empty table gives an empty result; other columns pass
    through, but for one named mix, which is replaced. Without a given period it has PERIOD slots, or SOURCE_SLOTS a source
    where that is more. The schedule is broadcast, at most SOURCE_SLOTS * MOST_SOURCES rows; a source with a third of all
    rows is ranked in many parts. Of more than MOST_SOURCES sources the small ones share lanes: share, block, release and
    deadline are then those of the lane, and such a source is less than two blocks from its weight.
    """
    columns = [c for c in docs.columns if c.lower() != "mix"]
    # the columns ride in one struct, so that none of them can clash with those of the ranks and the schedule
    docs = docs.select("doc_id", "source", F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row"))
    sizes = stored(sizes_of(docs, targets, power), "sources")
    total, count = sizes.agg(F.sum("n"), F.count("*")).first()
    bits = parts_for(total or 0).bit_length() + 3
    rows = docs.withColumn("_key", source_key(F.col("source"))).withColumn("_order", spread(F.col("doc_id")))
    rows = ranked(rows, "_key", F.shiftright("_order", 60 - bits), ["_order", "doc_id"], "_at")
    b = F.lit(block_rows).cast("bigint")
    rows = rows.withColumn("_block", F.expr(f"_at div {block_rows}")).withColumn("_place", F.pmod(F.col("_at"), b))
    while count > MOST_SOURCES:
        inner, sizes = laned(sizes, count, block_rows)
        inner, sizes = stored(inner, "plan"), stored(sizes, "sources")
        count = sizes.count()
        of = inner.groupBy("key").agg(F.first("lane").alias("_lane"), F.first("p").alias("_p"), F.first("period").alias("_q"))
        rows = rows.join(of.withColumnRenamed("key", "_key"), "_key", "left").withColumn("_k", F.pmod(F.col("_block"), F.col("_p")))
        at = inner.select(F.col("key").alias("_key"), F.col("k").alias("_k"), F.col("t").alias("_t"))
        # a block of a source in a lane becomes the lane's block; sources left alone keep theirs
        rows = rows.join(at, ["_key", "_k"], "left").withColumn("_block", F.coalesce(F.expr("_block div _p * _q + _t"), F.col("_block")))
        rows = rows.withColumn("_key", F.coalesce("_lane", "_key")).drop("_lane", "_p", "_q", "_k", "_t")
    period = period or max(PERIOD, SOURCE_SLOTS * count)
    plan = schedule(apportioned(sizes, period), period, block_rows)
    q = F.lit(period).cast("bigint")
    plan = plan.select(F.col("key").alias("_key"), F.col("p").alias("_p"), F.col("k").alias("_k"), F.col("t").alias("_t"), F.col("stop").alias("_end"))
    share = plan.groupBy("_key").agg(F.first("_p").alias("_p"))
    rows = rows.join(F.broadcast(share), "_key").withColumn("_k", F.pmod(F.col("_block"), F.col("_p")))
    rows = rows.join(F.broadcast(plan.drop("_p")), ["_key", "_k"])
    slot = F.expr("_block div _p") * q + F.col("_t")
    mix = F.struct(
        F.col("_p").alias("share"),
        F.col("_block").alias("block"),
        F.floor(F.col("_block") * q / F.col("_p")).alias("release"),
        F.ceil((F.col("_block") + 1) * q / F.col("_p")).alias("deadline"),
        slot.alias("slot"),
        F.col("_place").alias("place"),
        (slot < F.col("_end")).alias("on_target"),
    )
    return rows.select("_row", mix.alias("mix")).select("_row.*", "mix")


def op4_source_mix(spark, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir).select("doc_id", "source")).select("doc_id", "source", "mix.*")


QUERIES = {"op4_source_mix": op4_source_mix}
#: The schedule of a period by a recursive simulation, slot by slot; for up to PERIOD / SOURCE_SLOTS sources.
SQL = {
    "op4_source_mix": f"""
        WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('=' || source, 'null') AS key, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS o FROM documents),
        s AS (SELECT key, count(*) AS n, pow(count(*), {POWER}) AS w FROM d GROUP BY 1),
        e AS (SELECT *, w / sum(w) OVER () * ({PERIOD} - count(*) OVER ()) AS x, count(*) OVER () AS c FROM s),
        f AS (SELECT *, CAST({PERIOD} - c - sum(floor(x)) OVER () AS BIGINT) AS spare, row_number() OVER (ORDER BY floor(x) - x, key) AS place FROM e),
        p AS (SELECT key, n, CAST(1 + floor(x) + (spare + c - place) // c AS BIGINT) AS p FROM f),
        l AS (SELECT list(key ORDER BY key) AS keys, list(p ORDER BY key) AS ps, list(n ORDER BY key) AS ns FROM p),
        sim(t, k, i) AS (
          SELECT CAST(-1 AS BIGINT), list_transform(ps, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT) FROM l
          UNION ALL
          SELECT t + 1, list_transform(k, lambda x, j: CASE WHEN j = pick THEN x + 1 ELSE x END), pick FROM (
            SELECT t, k, list_position(due, list_min(due)) AS pick FROM (
              SELECT t, k, list_transform(k, lambda x, j: CASE WHEN x < ps[j] AND x * {PERIOD} // ps[j] <= t + 1 THEN ((x + 1) * {PERIOD} + ps[j] - 1) // ps[j] ELSE {PERIOD} * 10 END) AS due FROM sim, l WHERE t < {PERIOD} - 1))),
        plan AS (SELECT keys[i] AS key, t, row_number() OVER (PARTITION BY i ORDER BY t) - 1 AS k FROM sim, l WHERE t >= 0),
        stop AS (SELECT min(((n + {BLOCK_ROWS} - 1) // {BLOCK_ROWS}) * {PERIOD} // p) AS stop FROM p),
        r AS (SELECT doc_id, source, key, row_number() OVER (PARTITION BY key ORDER BY o, doc_id) - 1 AS pos FROM d),
        b AS (SELECT doc_id, source, p.p, pos // {BLOCK_ROWS} AS block, pos % {BLOCK_ROWS} AS place, r.key FROM r JOIN p ON p.key = r.key)
        SELECT doc_id, source, p AS share, block, block * {PERIOD} // p AS release, ((block + 1) * {PERIOD} + p - 1) // p AS deadline, block // p * {PERIOD} + t AS slot, place, block // p * {PERIOD} + t < stop AS on_target
        FROM b JOIN plan ON plan.key = b.key AND plan.k = block % p, stop
    """
}
