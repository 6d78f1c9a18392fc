"""Queries over scores, intervals, baselines and faithfulness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweir.functions import identity as I
from lumenweir.functions import reports as R
from lumenweir.functions import text as T
from lumenweir.operators import generation as G
from lumenweir.operators import manifest as N
from lumenweir.operators import metrics as M
from lumenweir.operators.ranks import next_in_ring
from lumenweir.plans.corpus import CORPUS, PREDICTIONS, ROWS, corpus, predictions, rows
from lumenweir.sources.tables import table

#: Draws at most, and replicates that count.
DRAWS, REPLICATES = 20_000, 2000


def main_seed(spark, d) -> DataFrame:
    return predictions(spark, d).filter("seed = 42")


def confusion_matrix(spark, d) -> DataFrame:
    return M.confusion(main_seed(spark, d), "mode")


def macro_f1(spark, d) -> DataFrame:
    return M.scores(main_seed(spark, d), "mode")


def scores_by_collection(spark, d) -> DataFrame:
    return M.scores_with_total(main_seed(spark, d))


def seed_summary(spark, d) -> DataFrame:
    return M.seed_summary(predictions(spark, d))


def bootstrap_macro_f1(spark, d) -> DataFrame:
    return M.bootstrap(main_seed(spark, d), DRAWS, "4242", [("report", "label"), ("report_vf", "report")], REPLICATES)


def bootstrap_in_collection(spark, d) -> DataFrame:
    return M.bootstrap(main_seed(spark, d), DRAWS, "4242", None, REPLICATES, "collection")


def majority_baselines(spark, d) -> DataFrame:
    r = rows(spark, d)
    train, test = r.filter("partition = 'train'"), r.filter("partition = 'test'")
    one = lambda key: M.majority_baseline(train, test, key).select("query_id", F.lit(key).alias("mode"), "predicted")
    return one("collection").unionByName(one("version")).unionByName(test.select("query_id", F.lit("constant").alias("mode"), F.lit("ABSENT").alias("predicted")))


def tfidf_terms(spark, d) -> DataFrame:
    tokens = corpus(spark, d).select(F.col("path").alias("id"), F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("tokens"))
    w = M.tfidf(tokens).groupBy("id").agg(F.count("*").alias("terms"), F.sum("tf").alias("n"), F.max_by("term", F.struct("tf", "term")).alias("most"), F.max("weight").alias("w"))
    return w.select("id", "terms", "n", "most", F.round("w", 6).alias("max_weight"))


def tfidf_logreg(spark, d) -> DataFrame:
    c = corpus(spark, d).select(F.col("path").alias("id"), "text", "label", I.drawn(F.col("path").cast("string"), 4).alias("fold"))
    return M.tfidf_classifier(c.filter("fold > 0"), c.filter("fold = 0"))


def stand_in(prompts: list[str]) -> list[str]:
    """A model whose answer follows from a prompt's length."""
    return [("PRESENT", " ABSENT\n", "perhaps")[len(p) % 3] for p in prompts]


def generated_predictions(spark, d) -> DataFrame:
    """Predictions of a stand-in model for all labelled texts, in batches of at most 25,000 padded tokens."""
    text = F.col("text")
    records = corpus(spark, d).select(F.col("path").alias("id"), text.alias("prompt"), F.size(T.word_tokens(text)).cast("bigint").alias("tokens"), F.col("label").alias("gold"), "collection", F.col("identity").alias("group_id"), F.col("version").alias("pragma_minor"), F.size(F.split(text, "\n")).alias("line_count"))
    return G.predictions(G.generated(records, stand_in, 25_000), R.label_verdict(F.col("raw")))


def interventions(spark, d) -> DataFrame:
    p = main_seed(spark, d).select("mode", "id", "gold", F.col("predicted").alias("original"))
    ring = next_in_ring(p, "mode", "id", "original", "donor")
    pick = I.drawn(F.concat_ws(":", F.lit("f"), "mode", F.col("id").cast("string")), 4)
    return ring.select("mode", "gold", "original", "donor", F.when(pick == 0, "INVALID").otherwise(F.col("original")).alias("own"), F.when(pick <= 1, "PRESENT").otherwise("ABSENT").alias("empty"), F.when(pick <= 2, F.col("donor")).otherwise(F.col("original")).alias("swapped"))


def faithfulness_rates(spark, d) -> DataFrame:
    return M.faithfulness(interventions(spark, d), "mode")


def grounding_totals(spark, d) -> DataFrame:
    i = F.col("doc_id")
    code = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda k: F.when((k + i) % 3 == 0, F.lit(" ")).otherwise(F.lit("code"))), "\n")
    analysis = F.concat(F.lit("See line "), (i % 25 + 1).cast("string"), F.lit(" and more. It is "), F.when(i % 4 == 0, F.lit("present")).otherwise("absent"), F.lit("."))
    present = i % 2 == 0
    return M.grounding(table(spark, d, "documents").select(F.col("doc_id").alias("id"), analysis.alias("analysis"), F.when(present, "PRESENT").otherwise("ABSENT").alias("verdict"), F.when(present, i % 18 + 1).alias("start_line"), F.when(present, i % 18 + 1 + i % 2).alias("end_line"), code.alias("code")))


def coverage_antijoin(spark, d) -> DataFrame:
    return N.coverage(table(spark, d, "labels").select("doc_id"), table(spark, d, "documents").select((F.col("doc_id") * 2).alias("doc_id")), "doc_id")


def best_checkpoint(spark, d) -> DataFrame:
    f1 = M.scores(predictions(spark, d).withColumn("epoch", F.col("id") % 6 + 1), "mode", "epoch")
    return M.best_checkpoint(f1.select("mode", "epoch", F.round("macro_f1", 1).alias("score")), "mode")


_F = (confusion_matrix, macro_f1, scores_by_collection, seed_summary, bootstrap_macro_f1, bootstrap_in_collection, majority_baselines, tfidf_terms, tfidf_logreg, faithfulness_rates, grounding_totals, coverage_antijoin, best_checkpoint, generated_predictions)
QUERIES = {f.__name__: f for f in _F}


def f1_sql(where: str = "") -> str:
    """Macro-F1 of a group in SQL, of rows that satisfy `where` as predictions."""

    def one(v: str) -> str:
        tp, pr, go = f"count_if(gold = '{v}' AND predicted = '{v}')", f"count_if(predicted = '{v}')", f"count_if(gold = '{v}'{where})"
        return f"CASE WHEN {tp} > 0 THEN 2 * {tp} / ({pr} + {go}) ELSE 0 END"

    return f"CAST(({one('PRESENT')} + {one('ABSENT')}) / 2 AS DOUBLE)"


P42 = f"WITH {PREDICTIONS}, p AS (SELECT * FROM pred WHERE seed = 42)"


def boot_sql(within: str, comparisons: bool) -> str:
    """The rule over the first 2 * REPLICATES draws, which hold REPLICATES valid ones unless the groups are very few."""
    both = """ UNION ALL SELECT x.w, x.r, 'report - label', x.f1 - y.f1 FROM f x JOIN f y ON x.r = y.r AND x.mode = 'report' AND y.mode = 'label'
        UNION ALL SELECT x.w, x.r, 'report_vf - report', x.f1 - y.f1 FROM f x JOIN f y ON x.r = y.r AND x.mode = 'report_vf' AND y.mode = 'report'"""
    parts = ", ".join(f"sum(times * tp_{k}) AS tp_{k}, sum(times * pr_{k}) AS pr_{k}, sum(times * go_{k}) AS go_{k}" for k in "pa")
    counts = ", ".join(f"count_if(gold = '{v}' AND predicted = '{v}') AS tp_{k}, count_if(predicted = '{v}') AS pr_{k}, count_if(gold = '{v}') AS go_{k}" for v, k in (("PRESENT", "p"), ("ABSENT", "a")))
    one = lambda k: f"CASE WHEN tp_{k} > 0 THEN 2 * tp_{k} / (pr_{k} + go_{k}) ELSE 0 END"
    return f"""{P42}, v AS (SELECT {within} AS w, mode, group_id, {counts} FROM p GROUP BY ALL), g AS (SELECT w, group_id, row_number() OVER (PARTITION BY w ORDER BY CAST(group_id AS VARCHAR)) - 1 AS k FROM (SELECT DISTINCT w, group_id FROM v)),
        n AS (SELECT w, count(*) AS n FROM g GROUP BY 1), pulls AS (SELECT w, r, ('0x' || substr(sha256('4242:' || r || ':' || d), 1, 8))::BIGINT % n AS k FROM range({2 * REPLICATES}) a(r), (SELECT w, n, unnest(range(n)) AS d FROM n)),
        t AS (SELECT w, r, k, count(*) AS times FROM pulls GROUP BY ALL), s AS (SELECT w, r, mode, {parts} FROM t JOIN g USING (w, k) JOIN v USING (w, group_id) GROUP BY ALL),
        f0 AS (SELECT w, r, mode, CAST(({one("p")} + {one("a")}) / 2 AS DOUBLE) AS f1 FROM s WHERE go_p > 0 AND go_a > 0),
        f AS (SELECT * FROM f0 WHERE (w, r) IN (SELECT (w, r) FROM (SELECT w, r, row_number() OVER (PARTITION BY w ORDER BY r) AS i FROM (SELECT DISTINCT w, r FROM f0)) WHERE i <= {REPLICATES})),
        every AS (SELECT w, r, mode AS name, f1 FROM f {both if comparisons else ""})
        SELECT {"" if comparisons else "w AS collection, "}name, count(*) AS replicates, quantile_cont(f1, 0.025) AS low, quantile_cont(f1, 0.975) AS high FROM every GROUP BY {"1" if comparisons else "1, 2"}"""


SQL = {
    "generated_predictions": f"""WITH {CORPUS}, a AS (SELECT *, CASE length(text) % 3 WHEN 0 THEN 'PRESENT' WHEN 1 THEN ' ABSENT' || chr(10) ELSE 'perhaps' END AS raw FROM corpus)
        SELECT path AS id, label AS gold, CASE length(text) % 3 WHEN 0 THEN 'PRESENT' WHEN 1 THEN 'ABSENT' ELSE 'INVALID' END AS predicted, raw, collection, identity AS group_id, version AS pragma_minor,
        CAST(len(string_split(text, chr(10))) AS BIGINT) AS line_count FROM a""",
    "confusion_matrix": P42 + " SELECT mode, gold, CAST(count_if(predicted = 'PRESENT') AS BIGINT) AS present, CAST(count_if(predicted = 'ABSENT') AS BIGINT) AS absent, CAST(count_if(predicted = 'INVALID') AS BIGINT) AS invalid FROM p GROUP BY ALL",
    "macro_f1": P42
    + f""" SELECT mode, count(*) AS n, CAST(count_if(predicted = 'INVALID') AS BIGINT) AS invalid, avg(CAST(gold = predicted AS DOUBLE)) AS accuracy,
        count_if(gold = 'PRESENT' AND predicted = 'PRESENT') / nullif(count_if(predicted = 'PRESENT'), 0) AS present_precision, count_if(gold = 'PRESENT' AND predicted = 'PRESENT') / nullif(count_if(gold = 'PRESENT'), 0) AS present_recall,
        {f1_sql()} AS macro_f1, {f1_sql(" AND predicted <> 'INVALID'")} AS macro_f1_valid_only FROM p GROUP BY 1""",
    "scores_by_collection": P42 + f" SELECT mode, CASE WHEN grouping(collection) = 1 THEN 'all' ELSE collection END AS collection, count(*) AS n, {f1_sql()} AS macro_f1 FROM p GROUP BY GROUPING SETS ((mode), (mode, collection))",
    "seed_summary": f"""WITH {PREDICTIONS}, f AS (SELECT mode, seed, CASE WHEN grouping(collection) = 1 THEN 'all' ELSE collection END AS scope, {f1_sql()} AS f1 FROM pred GROUP BY GROUPING SETS ((mode, seed), (mode, seed, collection)))
        SELECT mode, scope, count(*) AS seeds, avg(f1) AS mean, stddev_samp(f1) AS sd FROM f GROUP BY 1, 2 HAVING count(*) >= 2""",
    "bootstrap_macro_f1": boot_sql("''", True),
    "bootstrap_in_collection": boot_sql("collection", False),
    "majority_baselines": f"""WITH {ROWS}, tr AS (SELECT * FROM r WHERE partition = 'train'), te AS (SELECT * FROM r WHERE partition = 'test'),
        c AS (SELECT collection, count_if(label = 'PRESENT') > count_if(label = 'ABSENT') AS p FROM tr GROUP BY 1), v AS (SELECT version, count_if(label = 'PRESENT') > count_if(label = 'ABSENT') AS p FROM tr GROUP BY 1)
        SELECT query_id, 'collection' AS mode, CASE WHEN coalesce(p, FALSE) THEN 'PRESENT' ELSE 'ABSENT' END AS predicted FROM te LEFT JOIN c USING (collection)
        UNION ALL SELECT query_id, 'version', CASE WHEN coalesce(p, FALSE) THEN 'PRESENT' ELSE 'ABSENT' END FROM te LEFT JOIN v USING (version)
        UNION ALL SELECT query_id, 'constant', 'ABSENT' FROM te""",
    "tfidf_terms": f"""WITH {CORPUS}, t AS (SELECT path AS id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM corpus),
        g AS (SELECT id, unnest(w) AS term FROM t UNION ALL SELECT id, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i+1], ' '))) FROM t WHERE len(w) >= 2),
        tf AS (SELECT id, term, count(*) AS tf FROM g GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM t),
        x AS (SELECT id, term, tf, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), n)
        SELECT id, count(*) AS terms, CAST(sum(tf) AS BIGINT) AS n, arg_max(term, row(tf, term)) AS most, round(max(w) / sqrt(sum(w * w)), 6) AS max_weight FROM x GROUP BY 1""",
    "faithfulness_rates": P42
    + """, q AS (SELECT mode, id, gold, predicted AS original, coalesce(lead(predicted) OVER w, first(predicted) OVER w) AS donor, ('0x' || substr(sha256('f:' || mode || ':' || id), 1, 8))::BIGINT % 4 AS k FROM p WINDOW w AS (PARTITION BY mode ORDER BY id)),
        z AS (SELECT *, CASE WHEN k = 0 THEN 'INVALID' ELSE original END AS own, CASE WHEN k <= 1 THEN 'PRESENT' ELSE 'ABSENT' END AS empty, CASE WHEN k <= 2 THEN donor ELSE original END AS swapped, donor <> original AS dif FROM q)
        SELECT mode, count(*) AS contracts, count_if(own = original) / count(*) AS own_reproduces, count_if(empty = gold) / count(*) AS empty_accuracy, count_if(empty = 'PRESENT') / count(*) AS empty_present_share,
          CAST(count_if(dif) AS BIGINT) AS swap_pairs, count_if(dif AND swapped = donor) / nullif(count_if(dif), 0) AS swapped_follows_donor, count_if(dif AND swapped = original) / nullif(count_if(dif), 0) AS swapped_keeps_own FROM z GROUP BY 1""",
    "grounding_totals": """WITH x AS (SELECT doc_id AS i, doc_id % 25 + 1 AS c, doc_id % 2 = 0 AS present, doc_id % 18 + 1 AS s, doc_id % 18 + 1 + doc_id % 2 AS e FROM documents),
        y AS (SELECT *, c <= 20 AND (c + i) % 3 <> 0 AS on_code, present = (i % 4 = 0) AS states, present AND ((s + i) % 3 <> 0 OR e > s AND (e + i) % 3 <> 0) AS placed FROM x)
        SELECT count(*) AS valid_reports, count(*) AS cited_line_numbers, count_if(on_code) / count(*) AS cited_lines_on_code, count_if(states) / count(*) AS conclusion_states_own_verdict,
          CAST(count_if(present) AS BIGINT) AS locations, count_if(placed) / count_if(present) AS locations_on_code FROM y""",
    "coverage_antijoin": """SELECT count(*) FILTER (d IS NULL) AS missing, count(*) FILTER (l IS NULL) AS unexpected FROM (SELECT DISTINCT doc_id AS l FROM labels) FULL JOIN (SELECT DISTINCT doc_id * 2 AS d FROM documents) ON l = d""",
    "best_checkpoint": f"WITH {PREDICTIONS}, f AS (SELECT mode, id % 6 + 1 AS epoch, round({f1_sql()}, 1) AS score FROM pred GROUP BY 1, 2) SELECT mode, arg_max(epoch, row(score, -epoch)) AS epoch, max(score) AS score FROM f GROUP BY 1",
}
