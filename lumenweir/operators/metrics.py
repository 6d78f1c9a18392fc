"""Classification scores, cluster bootstrap, baselines, seed summaries and faithfulness rates, as grouped aggregates.

Predictions are long: mode, id, gold, predicted (PRESENT, ABSENT or INVALID), collection, group_id. INVALID is a miss for
its gold label and never a false positive.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenweir.operators.ranks import ranked
from lumenweir.operators.similarity import parts_of
from lumenweir.sources.tables import stored

LABELS = ("PRESENT", "ABSENT")
#: Terms that a partition of TF-IDF is meant to hold.
PART_TERMS = 1 << 20


def count_vector() -> list[Column]:
    """True positives, predictions and gold rows of each label: all that macro-F1 needs, and they add up."""
    out = []
    for v, k in zip(LABELS, ("p", "a"), strict=True):
        out += [F.count_if((F.col("gold") == v) & (F.col("predicted") == v)).alias(f"tp_{k}"), F.count_if(F.col("predicted") == v).alias(f"pred_{k}"), F.count_if(F.col("gold") == v).alias(f"gold_{k}")]
    return out


COUNTS = ("tp_p", "pred_p", "gold_p", "tp_a", "pred_a", "gold_a")


def macro_f1(prefix: str = "") -> Column:
    """Mean over the labels of 2 tp / (predicted + gold), 0 without a true positive."""
    f1 = lambda k: F.when(F.col(f"{prefix}tp_{k}") > 0, 2 * F.col(f"{prefix}tp_{k}") / (F.col(f"{prefix}pred_{k}") + F.col(f"{prefix}gold_{k}"))).otherwise(F.lit(0.0))
    return (f1("p") + f1("a")) / 2


def confusion(predictions: DataFrame, *by: str) -> DataFrame:
    out = predictions.groupBy(*by, "gold").pivot("predicted", ["PRESENT", "ABSENT", "INVALID"]).count()
    return out.select(*by, "gold", *(F.coalesce(c, F.lit(0)).alias(c.lower()) for c in ("PRESENT", "ABSENT", "INVALID")))


def scores(predictions: DataFrame, *by: str) -> DataFrame:
    """n, invalid, accuracy, present_precision, present_recall, macro_f1, macro_f1_valid_only by the given columns."""
    valid = F.col("predicted") != "INVALID"
    counts = [*count_vector(), F.count("*").alias("n"), F.count_if(~valid).alias("invalid"), F.avg((F.col("gold") == F.col("predicted")).cast("double")).alias("accuracy")]
    counts += [F.count_if(valid & (F.col("gold") == v)).alias(f"v_gold_{k}") for v, k in zip(LABELS, "pa", strict=True)]
    out = predictions.groupBy(*by).agg(*counts)
    out = out.withColumns({f"v_{c}": F.col(c) for c in COUNTS if "gold" not in c})
    return out.select(
        *by,
        "n",
        "invalid",
        "accuracy",
        F.try_divide("tp_p", "pred_p").alias("present_precision"),
        F.try_divide("tp_p", "gold_p").alias("present_recall"),
        macro_f1().alias("macro_f1"),
        F.when(F.col("invalid") < F.col("n"), macro_f1("v_")).alias("macro_f1_valid_only"),
    )


def scores_with_total(predictions: DataFrame) -> DataFrame:
    """mode, collection (`all` for the total), n, macro_f1: one pass by grouping sets."""
    sets = predictions.groupingSets([["mode"], ["mode", "collection"]], "mode", "collection").agg(*count_vector(), F.count("*").alias("n"), F.grouping("collection").alias("g"))
    return sets.select("mode", F.when(F.col("g") == 1, "all").otherwise(F.col("collection")).alias("collection"), "n", macro_f1().alias("macro_f1"))


def seed_summary(predictions: DataFrame) -> DataFrame:
    """mode, scope, seeds, mean, sd (sample) of macro-F1 over seeds; modes with one seed are left out."""
    one = predictions.groupingSets([["mode", "seed"], ["mode", "seed", "collection"]], "mode", "seed", "collection").agg(*count_vector(), F.grouping("collection").alias("g"))
    f1 = one.select("mode", "seed", F.when(F.col("g") == 1, "all").otherwise(F.col("collection")).alias("scope"), macro_f1().alias("f1"))
    out = f1.groupBy("mode", "scope").agg(F.count("*").alias("seeds"), F.avg("f1").alias("mean"), F.stddev_samp("f1").alias("sd"))
    return out.filter("seeds >= 2")


def bootstrap(predictions: DataFrame, draws: int, seed: str, comparisons: list[tuple[str, str]] | None = None, replicates: int | None = None, within: str | None = None) -> DataFrame:
    """name, replicates, low, high: 95% intervals of macro-F1 of each mode and of differences of modes, resampling groups.

    Each replicate draws as many groups as there are, by the SHA-256 of seed, replicate and draw, the same for all modes;
    replicates without both labels are rejected, and the first `replicates` of the others count (all, if None) of at most
    `draws`. Draws are made in rounds until enough are valid. Rows are never copied: a group's count vector is weighted by
    how often it was drawn. Groups are numbered in order of their id's text, by parts of its first characters. With `within`, a
    column, each of its values has groups, draws and rows of its own.
    """
    cell = F.col(within) if within else F.lit("")
    vectors = stored(predictions.groupBy(cell.cast("string").alias("w"), "mode", "group_id").agg(*count_vector()), "vectors")
    numbered = stored(ranked(vectors.select("w", "group_id").distinct(), "w", F.substring(F.col("group_id").cast("string"), 1, 2), [F.col("group_id").cast("string")], "k"), "numbered")
    sizes = stored(numbered.groupBy("w").agg(F.count("*").alias("n")), "sizes")
    rounds, done = [], 0
    while done < draws:
        step = draws - done if replicates is None else min(draws - done, max(replicates + replicates // 20, 1))
        draw = sizes.select("w", "n", F.explode(F.sequence(F.lit(done).cast("bigint"), F.lit(done + step - 1).cast("bigint"))).alias("r")).repartition("w", "r")
        pulls = draw.select("w", "r", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("d"))
        key = F.concat_ws(":", F.lit(seed), F.col("r").cast("string"), F.col("d").cast("string"))
        pick = F.pmod(F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint"), F.col("n"))
        times = pulls.select("w", "r", pick.alias("k")).groupBy("w", "r", "k").agg(F.count("*").alias("times"))
        drawn = times.join(numbered, ["w", "k"]).join(vectors, ["w", "group_id"]).groupBy("w", "r", "mode").agg(*(F.sum(F.col("times") * F.col(c)).alias(c) for c in COUNTS))
        f1 = stored(drawn.filter("gold_p > 0 AND gold_a > 0").select("w", "r", "mode", macro_f1().alias("f1")), "draws")
        rounds.append(f1)
        done += step
        f1 = reduce(DataFrame.unionByName, rounds)
        if replicates is None or not sizes.join(f1.groupBy("w").agg(F.countDistinct("r").alias("v")), "w", "left").filter(F.coalesce("v", F.lit(0)) < replicates).head(1):
            break
    if not rounds:
        f1 = vectors.filter("false").select("w", F.lit(0).cast("bigint").alias("r"), "mode", F.lit(0.0).alias("f1"))
    if replicates is not None:
        # at most `draws` rows for each value of `within`
        valid = f1.select("w", "r").distinct().withColumn("i", F.row_number().over(Window.partitionBy("w").orderBy("r"))).filter(F.col("i") <= replicates)
        f1 = f1.join(valid.drop("i"), ["w", "r"], "left_semi")
    out = f1.select("w", F.col("mode").alias("name"), "f1")
    for a, b in comparisons or []:
        x, y = f1.filter(F.col("mode") == a).select("w", "r", F.col("f1").alias("x")), f1.filter(F.col("mode") == b).select("w", "r", F.col("f1").alias("y"))
        out = out.unionByName(x.join(y, ["w", "r"]).select("w", F.lit(f"{a} - {b}").alias("name"), (F.col("x") - F.col("y")).alias("f1")))
    p = F.percentile("f1", F.array(F.lit(0.025), F.lit(0.975)))
    got = out.groupBy("w", "name").agg(F.count("*").alias("replicates"), p.alias("p"))
    return got.select(*([F.col("w").alias(within)] if within else []), "name", "replicates", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))


def majority_baseline(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """test with predicted: the label most of the training rows of its key have; ABSENT on a tie or for an unseen key."""
    most = train.groupBy(key).agg((F.count_if(F.col("label") == "PRESENT") > F.count_if(F.col("label") == "ABSENT")).alias("present"))
    return test.join(most, key, "left").withColumn("predicted", F.when(F.coalesce("present", F.lit(False)), "PRESENT").otherwise("ABSENT")).drop("present")


def best_checkpoint(rows: DataFrame, *by: str) -> DataFrame:
    """epoch, score of the best score; the earliest epoch on a tie. Rows are keyed by `by`."""
    best = F.max_by(F.struct("epoch", "score"), F.struct(F.col("score"), -F.col("epoch"))).alias("b")
    return rows.groupBy(*by).agg(best).select(*by, "b.*")


def faithfulness(rows: DataFrame, *by: str) -> DataFrame:
    """Rates of interventions: rows own, empty, swapped, donor, original, gold verdicts."""
    differs = F.col("donor") != F.col("original")
    n, d = F.greatest(F.count("*"), F.lit(1)), F.count_if(differs)
    return rows.groupBy(*by).agg(
        F.count("*").alias("contracts"),
        (F.count_if(F.col("own") == F.col("original")) / n).alias("own_reproduces"),
        (F.count_if(F.col("empty") == F.col("gold")) / n).alias("empty_accuracy"),
        (F.count_if(F.col("empty") == "PRESENT") / n).alias("empty_present_share"),
        d.alias("swap_pairs"),
        F.try_divide(F.count_if(differs & (F.col("swapped") == F.col("donor"))), d).alias("swapped_follows_donor"),
        F.try_divide(F.count_if(differs & (F.col("swapped") == F.col("original"))), d).alias("swapped_keeps_own"),
    )


def grounding(reports: DataFrame) -> DataFrame:
    """Totals and ratios of valid reports (id, analysis, verdict, start_line, end_line, code): cited lines on code,
    conclusions that state their own verdict, locations on code."""
    from lumenweir.functions.text import citations, states_verdict

    lines = F.split("code", "\n", -1)
    on = lambda i: F.coalesce(F.length(F.trim(F.try_element_at(lines, i.cast("int")))) > 0, F.lit(False))
    cited = citations(F.col("analysis"))
    r = reports.select(
        F.size(cited).alias("cited"),
        F.size(F.filter(cited, lambda k: (k >= 1) & on(k))).alias("on_code"),
        states_verdict(F.col("analysis"), F.col("verdict"), LABELS).alias("states"),
        F.col("start_line").isNotNull().alias("located"),
        F.coalesce(F.exists(F.slice(lines, F.greatest(F.coalesce("start_line", F.lit(1)), F.lit(1)).cast("int"), F.greatest(F.coalesce(F.col("end_line") - F.col("start_line") + 1, F.lit(0)), F.lit(0)).cast("int")), lambda x: F.length(F.trim(x)) > 0), F.lit(False)).alias("placed"),
    )
    return r.agg(
        F.count("*").alias("valid_reports"),
        F.sum("cited").cast("bigint").alias("cited_line_numbers"),
        F.try_divide(F.sum("on_code"), F.sum("cited")).alias("cited_lines_on_code"),
        F.try_divide(F.count_if("states"), F.count("*")).alias("conclusion_states_own_verdict"),
        F.count_if("located").alias("locations"),
        F.try_divide(F.count_if(F.col("located") & F.col("placed")), F.count_if("located")).alias("locations_on_code"),
    )


def tfidf(tokens: DataFrame, most_gram: int = 2) -> DataFrame:
    """id, term, tf, df, weight: 1- to n-grams, idf ln((1 + n) / (1 + df)) + 1, L2-normalised within the document.

    tokens: id, tokens array<string>."""
    def runs(g: int) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.greatest(F.size("tokens") - g + 1, F.lit(1))), lambda i: F.array_join(F.slice("tokens", i, F.lit(g)), " "))
        return F.when(F.size("tokens") >= g, found).otherwise(F.array().cast("array<string>"))

    grams = F.concat(*map(runs, range(1, most_gram + 1)))
    # tokens move to their id, each term to its equals once, and back once; partitions are small enough to be sorted in memory
    n = tokens.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.size("tokens").cast("bigint")), F.lit(0)).alias("words")).first()
    parts = parts_of(tokens.sparkSession, most_gram * n.words, PART_TERMS)
    own = tokens.repartition(parts, "id").select("id", F.explode(grams).alias("term"))
    tf = own.groupBy("id", "term").agg(F.count("*").alias("tf")).repartition(parts, "term")
    df = tf.withColumn("df", F.count("*").over(Window.partitionBy("term"))).repartition(parts, "id")
    raw = df.withColumn("w", F.col("tf") * (F.ln((1 + F.lit(n.docs)) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return raw.select("id", "term", "tf", "df", (F.col("w") / norm).alias("weight"))


def tfidf_classifier(train: DataFrame, test: DataFrame, c: float = 1.0, features: int = 1 << 18) -> DataFrame:
    """test (id, text, label) with predicted, by logistic regression on TF-IDF of 1- and 2-grams of identifiers and operator
    runs, case kept. The idf is smoothed and the penalty is per row, so that c means what it does in other libraries.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, ElementwiseProduct, HashingTF, NGram, Normalizer, RegexTokenizer
    from pyspark.ml.linalg import Vectors

    n = train.count()
    steps = Pipeline(stages=[RegexTokenizer(inputCol="text", outputCol="t1", pattern=r"[A-Za-z_$][\w$]*|[^\w\s]+", gaps=False, toLowercase=False), NGram(n=2, inputCol="t1", outputCol="t2")])
    both = lambda df: steps.fit(df).transform(df).withColumn("terms", F.concat("t1", "t2"))
    tf = HashingTF(inputCol="terms", outputCol="tf", numFeatures=features)
    scale = Normalizer(inputCol="idf", outputCol="features")
    fit = IDF(inputCol="tf", outputCol="raw").fit(tf.transform(both(train)))
    # smoothed idf is the library's plus one: tf * (idf + 1) = tf * idf + tf
    weights = [float(x) + 1.0 for x in fit.idf.toArray()]
    product = ElementwiseProduct(scalingVec=Vectors.dense(weights), inputCol="tf", outputCol="idf")
    ready = lambda df: scale.transform(product.transform(tf.transform(both(df)))).withColumn("y", (F.col("label") == "PRESENT").cast("double"))
    model = LogisticRegression(labelCol="y", regParam=1 / (c * max(n, 1)), standardization=False, maxIter=200).fit(ready(train))
    out = model.transform(ready(test))
    return out.select("id", "label", F.when(F.col("prediction") == 1.0, "PRESENT").otherwise("ABSENT").alias("predicted"))
