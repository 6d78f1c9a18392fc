from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from lumenweir.operators import merkle as K

SCHEMA = "name string, value string"


def sha(text):
    return sha256(text.encode()).hexdigest()


def root_of(values):
    """The rule by recursion over a list of values."""
    counts = Counter(sha(v) if v is not None else "0" * 64 for v in values)
    depth = 0
    while len(counts) > K.LEAF * 256**depth:
        depth += 1

    def node(prefix, level):
        own = sorted(d for d in counts if d.startswith(prefix))
        if level == depth:
            return sha(",".join(f"{d}:{counts[d]}" for d in own))
        return sha(",".join(f"{p}:{node(p, level + 1)}" for p in sorted({d[: 2 * level + 2] for d in own})))

    return depth, node("", 0)


@pytest.fixture(scope="module")
def values():
    return {"many": [f"v{i % 17000}" for i in range(17100)], "some": [f"x{i}" for i in range(200)] + ["x7"] * 500, "few": ["a", "a", None, ""], "": ["z"]}


def digests(spark, values):
    rows = [(k or None, v) for k, vs in values.items() for v in vs]
    return K.value_digests(spark.createDataFrame(rows, SCHEMA), F.col("name"), F.col("value"))


def test_roots_follow_the_rule(spark, values):
    tree = K.digest_tree(digests(spark, values))
    got = {r["name"]: (r.n, r.sha256) for r in K.roots(tree).collect()}
    want = {k: root_of(v) for k, v in values.items()}
    assert got == {k: (len(values[k]), want[k][1]) for k in values}
    assert {r["name"]: r.depth for r in tree.select("name", "depth").distinct().collect()} == {"many": 2, "some": 1, "few": 0, "": 0} == {k: d for k, (d, _) in want.items()}


def test_changes_are_found_by_descent(spark, values):
    later = {k: list(v) for k, v in values.items()}
    later["many"][5] = "changed"
    later["some"] += ["x7", "new"]
    later["few"].remove(None)
    later["none"] = ["n"]
    del later[""]
    a, b = digests(spark, values), digests(spark, later)
    got = {(r["name"], r.d): (r.stated, r.found) for r in K.changed_values(a, b).collect()}
    want = {}
    for k in {*values, *later}:
        x, y = (Counter(sha(v) if v is not None else "0" * 64 for v in s.get(k, [])) for s in (values, later))
        want |= {(k, d): (x[d], y[d]) for d in {*x, *y} if x[d] != y[d]}
    assert got == want and len(got) == 7
    tree = K.digest_tree(a)
    other = K.digest_tree(b, tree.filter("level = 0"))
    many = K.differing_leaves(tree, other).filter("name = 'many'")
    assert many.count() == 2  # of some 15,000 leaves


def test_same_values_in_another_order_have_the_same_tree(spark, values):
    some = {"some": values["some"]}
    a, b = digests(spark, some), digests(spark, {"some": values["some"][::-1]})
    assert K.changed_values(a, b).count() == 0
    assert K.roots(K.digest_tree(a)).collect() == K.roots(K.digest_tree(b.repartition(7))).collect()


def test_a_depth_that_changes_is_still_compared(spark):
    small, large = {"a": [f"v{i}" for i in range(60)]}, {"a": [f"v{i}" for i in range(70)]}
    got = {r.d for r in K.changed_values(digests(spark, small), digests(spark, large)).collect()}
    assert got == {sha(f"v{i}") for i in range(60, 70)}
    assert {r.d for r in K.changed_values(digests(spark, large), digests(spark, small)).collect()} == got


def test_empty_tables(spark):
    none, some = digests(spark, {}), digests(spark, {"a": ["x"]})
    assert K.digest_tree(none).count() == 0
    assert K.changed_values(none, none).count() == 0
    assert [(r.stated, r.found) for r in K.changed_values(some, none).collect()] == [(1, 0)]
    assert [(r.stated, r.found) for r in K.changed_values(none, some).collect()] == [(0, 1)]


def test_digests_of_a_name_are_not_brought_to_one_task(spark, monkeypatch):
    """Few names have few depths, and those are known when the join is planned: digests stay where they are."""
    plans, keep = {}, K.stored

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return keep(df, name)

    monkeypatch.setattr(K, "stored", seen)
    rows = spark.range(3000).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("k"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")  # less than the digests, more than the depths
    digests = keep(K.value_digests(rows, F.col("k"), F.col("v")), "digests")
    try:
        tree = K.digest_tree(digests)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plans["leaves"] and "BroadcastHashJoin" in plans["leaves"]
    assert sorted((r.name, r.n) for r in K.roots(tree).collect()) == [("a", 1500), ("b", 1500)]
