import random
import re

import pytest
from pyspark.sql.classic.dataframe import DataFrame

from lumenweir.llm import near as N
from lumenweir.operators.components import components


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def edited(rnd, w, share):
    return [rnd.choice(["q", "r", "s", "t"]) + x if rnd.random() < share else x for x in w]


def corpus(seed, n=150, clones=60):
    rnd = random.Random(seed)
    texts = []
    for _ in range(n):
        w = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.randint(3, 160))]
        texts.append(" ".join(w))
        for _ in range(rnd.randint(0, 3)):
            texts.append(" ".join(edited(rnd, w, rnd.choice([0, 0.005, 0.01, 0.02, 0.05]))))
    base = [f"c{i}" for i in range(200)]
    texts += [" ".join(edited(rnd, base, 0.01)) for _ in range(clones)]
    texts += [" ".join(base).upper(), " ".join(base) + " ", "a b", "A B", "a b c", "one two three four five", "x " * 50, "x " * 60]
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, make_docs, odd_texts, seed):
    rows = list(enumerate(odd_texts + corpus(seed)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_groups(make_docs(rows)).collect()}
    assert got == brute(rows)


def test_deep_trees_and_blocks_find_the_same_components(spark, make_docs, monkeypatch):
    monkeypatch.setattr(N, "LEAF", 8)
    monkeypatch.setattr(N, "LEVELS", 3)
    rows = list(enumerate(corpus(5, n=40, clones=120)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_groups(make_docs(rows)).collect()}
    assert got == brute(rows)


def test_isolated_links_in_a_family_below_the_threshold(spark, make_docs, monkeypatch):
    """120 texts of one template, 0.82 to 0.846 alike as they share one place of edits at most, and 40 lone partners at 0.905."""
    for name, value in {"LEAF": 8, "HUBS": 2, "LEVELS": 3, "TREES": 4}.items():
        monkeypatch.setattr(N, name, value)
    base = [f"c{i}" for i in range(304)]
    texts = []
    for i in range(120):
        a, b = divmod(i, 20)
        places = [5 * k + 4 for k in (a, 20 + b, 40 + (a + b) % 20)]
        for mark in "ef" if i % 3 == 0 else "e":
            texts.append(" ".join(f"{mark}{i}.{k}" if k in places else x for k, x in enumerate(base)))
    rows = list(enumerate(texts))
    want = brute(rows)
    assert sum(kept for _, _, kept in want.values()) == 120
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_groups(make_docs(rows)).collect()}
    assert got == want


def test_repeated_and_unnamed_rows_and_empty_table(spark, make_docs):
    long = " ".join(f"w{i}" for i in range(80))
    docs = make_docs([(3, long), (3, long), (7, long + " end"), (None, long), (9, None), (5, "alone here"), (5, long + " fin")])
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.near_groups(docs).collect()), key=str)
    assert got == sorted([(3, 76, 3, True), (3, 76, 3, True), (7, 77, 3, False), (None, 76, None, True), (9, 0, 9, True), (5, 1, 5, True), (5, 77, 5, True)], key=str)
    assert N.near_groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(2, 1), (2, 3), (9, 3), (5, 4)], [(i, i + 1) for i in range(40)] + [(100, 101)], [(0, i) for i in range(1, 50)]])
def test_components(spark, edges):
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_nodes_give_one_row_a_class_whatever_their_sizes(spark, monkeypatch):
    """A crowd in one node and classes alone in theirs: sizes are joined to as many rows, not to those that share a node."""
    counts, stored = {}, N.stored

    def counted(df, name):
        out = stored(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(N, "stored", counted)
    rows = [(i, [7 if i < 300 else i] * N.COORDINATES) for i in range(600)]
    met, crowds = N.leaves(spark.createDataFrame(rows, "cid bigint, sig array<int>"))
    assert counts["sized"] == counts["nodes"] == 600 * N.TREES
    assert crowds.count() == 300 * N.TREES
    assert {r.cid for r in met.select("cid").distinct().collect()} == set(range(300))


def test_a_class_is_joined_with_its_node_once_a_subtree_however_deep(spark, monkeypatch):
    """One crowd of 300 in a tree, seven in ten alike in each coordinate and not connected: several levels, one joined row a subtree."""
    for name, value in {"LEAF": 8, "WHOLE": 64}.items():
        monkeypatch.setattr(N, name, value)
    rnd = random.Random(3)
    classes = [(i, 100, bytes(0 if rnd.random() < 0.7 else rnd.randrange(1, 4) for _ in range(N.COORDINATES))) for i in range(300)]
    made, join = {}, DataFrame.join

    def counted(self, other, on=None, how=None):
        out = join(self, other, on, how)
        if isinstance(on, list) and on == ["tree", "node"] and "low" in self.columns:
            made.setdefault(how or "inner", []).append(out.count())
        return out

    monkeypatch.setattr(DataFrame, "join", counted)
    classes = spark.createDataFrame(classes, "cid bigint, n bigint, low binary")
    met = N.settled(spark.range(300).selectExpr("0 AS tree", "7L AS node", "id AS cid"), classes, spark.createDataFrame([], "node bigint, label bigint"))
    assert len(made["inner"]) > 3
    assert sum(made["inner"]) <= 300 * N.REPEATS
    # the filter's rows fall from level to level, and no more classes go on than come in
    assert made["left_semi"][0] == 300 and all(b < a for a, b in zip(made["left_semi"][1:], made["left_semi"][2:], strict=False))
    assert met.select("cid").distinct().count() == 300
