import math
import random
import statistics

from pyspark.sql import functions as F

from lumenweir.operators import attempts as A
from lumenweir.operators import formatting as M2
from lumenweir.operators import manifest as N
from lumenweir.operators import metrics as M

P = "mode string, id bigint, gold string, predicted string, collection string, group_id string"


def macro(pairs):
    out = []
    for v in M.LABELS:
        tp = sum(g == v == p for g, p in pairs)
        fp, fn = sum(g != v == p for g, p in pairs), sum(g == v != p for g, p in pairs)
        out.append(2 * tp / (2 * tp + fp + fn) if tp else 0.0)
    return sum(out) / 2


def sample(seed, n=80):
    rnd = random.Random(seed)
    return [(m, i, rnd.choice(M.LABELS), rnd.choice([*M.LABELS, "INVALID"]), rnd.choice("ab"), f"g{i % 9}") for m in ("x", "y") for i in range(n)]


def test_scores_equal_brute_force(spark):
    rows = sample(1)
    for r in M.scores(spark.createDataFrame(rows, P), "mode", "collection").collect():
        own = [(g, p) for m, _, g, p, c, _ in rows if (m, c) == (r.mode, r.collection)]
        assert math.isclose(r.macro_f1, macro(own)) and math.isclose(r.macro_f1_valid_only, macro([x for x in own if x[1] != "INVALID"]))
        assert math.isclose(r.accuracy, sum(g == p for g, p in own) / len(own)) and r.invalid == sum(p == "INVALID" for _, p in own)


def test_edges_of_scores(spark):
    rows = [("inv", i, v, "INVALID", "a", "g") for i, v in enumerate(M.LABELS * 2)] + [("abs", i, v, "ABSENT", "a", "g") for i, v in enumerate(M.LABELS * 2)]
    got = {r.mode: r for r in M.scores(spark.createDataFrame(rows, P), "mode").collect()}
    assert (got["inv"].macro_f1, got["inv"].macro_f1_valid_only) == (0.0, None)
    assert (got["abs"].present_precision, got["abs"].present_recall) == (None, 0.0) and math.isclose(got["abs"].macro_f1, 1 / 3)


def test_bootstrap_equals_resampling(spark):
    import hashlib

    rows = sample(2)
    groups = sorted({r[5] for r in rows})
    values = {"x": [], "y": [], "x - y": []}
    for r in range(60):
        picks = [groups[int(hashlib.sha256(f"s:{r}:{d}".encode()).hexdigest()[:8], 16) % len(groups)] for d in range(len(groups))]
        f = {m: macro([(g, p) for k in picks for mm, _, g, p, _, gr in rows if mm == m and gr == k]) for m in "xy"}
        values["x"].append(f["x"])
        values["y"].append(f["y"])
        values["x - y"].append(f["x"] - f["y"])

    def at(v, q):
        v, k = sorted(v), q * (len(v) - 1)
        lo = int(k)
        return v[lo] + (k - lo) * (v[min(lo + 1, len(v) - 1)] - v[lo])

    for r in M.bootstrap(spark.createDataFrame(rows, P), 60, "s", [("x", "y")]).collect():
        assert r.replicates == 60 and math.isclose(r.low, at(values[r.name], 0.025), abs_tol=1e-12) and math.isclose(r.high, at(values[r.name], 0.975), abs_tol=1e-12)


def test_majority_and_checkpoint(spark):
    train = spark.createDataFrame([("a", "PRESENT"), ("a", "PRESENT"), ("a", "ABSENT"), ("b", "PRESENT"), ("b", "ABSENT")], "k string, label string")
    test = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    assert {r.k: r.predicted for r in M.majority_baseline(train, test, "k").collect()} == {"a": "PRESENT", "b": "ABSENT", "c": "ABSENT"}
    runs = spark.createDataFrame([("m", 5, 0.8), ("m", 6, 0.8), ("m", 4, 0.7)], "mode string, epoch int, score double")
    assert M.best_checkpoint(runs, "mode").collect()[0].epoch == 5


def test_seed_summary_and_tfidf(spark):
    rows = [(m, s, i, v, v if (i + s) % 3 else "INVALID", "a", "g") for m, seeds in (("two", (1, 2)), ("one", (1,))) for s in seeds for i, v in enumerate(M.LABELS * 6)]
    df = spark.createDataFrame(rows, "mode string, seed int, id bigint, gold string, predicted string, collection string, group_id string")
    got = {(r.mode, r.scope): r for r in M.seed_summary(df).collect()}
    f1 = [macro([(g, p) for m, s, _, g, p, *_ in rows if (m, s) == ("two", seed)]) for seed in (1, 2)]
    assert set(got) == {("two", "all"), ("two", "a")} and math.isclose(got["two", "all"].sd, statistics.stdev(f1))
    t = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (3, [])], "id int, tokens array<string>")
    w = {(r.id, r.term): r.weight for r in M.tfidf(t).collect()}
    assert math.isclose(sum(v * v for (i, _), v in w.items() if i == 1), 1.0) and w[2, "b"] == 1.0 and set(k for i, k in w if i == 1) == {"a", "b", "a b", "b a"}


def test_tfidf_moves_terms_twice(spark):
    """To their equals and back; ids that come in several rows are one document, but count by their rows."""
    t = spark.createDataFrame([(i, [f"w{i % 7}", "the", f"x{i}", "the"]) for i in range(50)] + [(3, ["the"])], "id int, tokens array<string>")
    out = M.tfidf(t)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3 and plan.count("Scan") == 1  # tokens, terms, terms
    got = {(r.id, r.term): r for r in out.collect()}
    assert got[3, "the"].tf == 3 and got[3, "the"].df == 50 and got[3, "x3"].df == 1 and len(got) == 50 * 6
    raw = {term: r.tf * (math.log(52 / (1 + r.df)) + 1) for (i, term), r in got.items() if i == 3}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    assert all(math.isclose(got[3, term].weight, v / norm) for term, v in raw.items())


def test_logistic_baseline_learns(spark):
    rows = [(i, ("call value transfer " if i % 2 else "view pure return ") * 3 + f"x{i}", M.LABELS[0] if i % 2 else M.LABELS[1]) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, text string, label string")
    out = M.tfidf_classifier(df.filter("id < 40"), df.filter("id >= 40"), features=1 << 12).collect()
    assert len(out) == 20 and sum(r.label == r.predicted for r in out) >= 19


def test_attempts(spark):
    log = spark.createDataFrame([("a", 1, "invalid"), ("a", 2, "accepted"), ("b", 3, "invalid"), ("b", 4, "invalid"), ("c", 5, "invalid")], "query_id string, seq bigint, status string")
    keys = spark.createDataFrame([(k,) for k in "abcd"], "query_id string")
    assert {r.query_id: r.next_attempt for r in A.pending(keys, log, "query_id", "seq", 2).collect()} == {"c": 2, "d": 1}
    s = A.statuses(keys, log, "query_id", "seq", 2)
    assert {r.query_id: r.status for r in s.collect()} == {"a": "accepted", "b": "invalid", "c": "pending", "d": "pending"}
    assert {r.status: r.n for r in A.status_counts(s).collect()} == {"accepted": 1, "disagreed": 0, "unsupported": 0, "invalid": 1, "pending": 2}


def test_manifest(spark):
    rows = spark.createDataFrame([("a", str(i)) for i in range(50)] + [("b", "x")], "n string, v string")
    one = N.content_manifest(rows, F.col("n"), F.col("v"))
    again = N.content_manifest(rows.repartition(7).orderBy(F.rand()), F.col("n"), F.col("v"))
    assert {r.state for r in N.verified(one, again).collect()} == {"ok"}
    other = N.content_manifest(rows.filter("v <> '3'").union(spark.createDataFrame([("c", "1")], "n string, v string")).filter("n <> 'b'"), F.col("n"), F.col("v"))
    assert {r.name: r.state for r in N.verified(one, other).collect()} == {"a": "changed", "b": "missing", "c": "unexpected"}


def test_too_long_leaves_all_conditions(spark):
    r = spark.createDataFrame([(1, "label", 5), (1, "report", 50), (2, "label", 5), (2, "report", 6)], "id int, condition string, sequence_tokens int")
    assert [x.id for x in M2.too_long(r, 10).collect()] == [1]
