import random
import re
from collections import Counter

import pytest

from lumenweir.llm import substrings as S


def brute(texts, size):
    own = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    wins = Counter(tuple(w[i : i + size]) for w in own for i in range(len(w) - size + 1))
    out = []
    for w in own:
        gone = {i + j for i in range(len(w) - size + 1) if wins[tuple(w[i : i + size])] > 1 for j in range(size)}
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    vocab = ["a", "b", "é", "x,", "漢", "Tt"] if seed % 2 else [f"w{i}" for i in range(300)]
    shared = [[rnd.choice(vocab) for _ in range(rnd.randint(10, 120))] for _ in range(6)]
    texts = []
    for _ in range(120):
        w = []
        for _ in range(rnd.randint(0, 5)):
            w += rnd.choice(shared)[rnd.randint(0, 8) :] if rnd.random() < 0.5 else [rnd.choice(vocab) for _ in range(rnd.randint(0, 60))]
        texts.append(rnd.choice([" ", "\n", "\t "]).join(w))
    return texts + ["same"] * 4 + ["orre " * 90, "orre " * 34, "orre " * 35, "z " * 36]


@pytest.mark.parametrize("seed", [0, 1])
@pytest.mark.parametrize("size", [35, 5])
def test_equals_brute_force(spark, make_docs, odd_texts, seed, size):
    texts = odd_texts[:8] + [t and t[:6000] for t in odd_texts[8:]] + corpus(seed)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in S.without_repeats(make_docs(texts), size).collect()}
    want = brute(texts, size)
    assert [got[i] for i in range(len(texts))] == want


def test_spans_repeated_rows_and_empty_table(spark, make_docs):
    line = " ".join(f"w{i}" for i in range(40))
    docs = make_docs([(1, "x " + line), (1, "x " + line), (None, line + " y"), (3, "short")])
    rows = S.without_repeats(docs).collect()
    assert sorted((r.n_words, r.n_removed, tuple((s.start, s.end) for s in r.removed)) for r in rows) == [(1, 0, ()), (41, 40, ((0, 40),)), (41, 41, ((0, 41),)), (41, 41, ((0, 41),))]
    assert S.without_repeats(docs.limit(0)).count() == 0


def test_index_finds_history_and_compacts(spark, make_docs):
    rnd = random.Random(3)
    new = lambda: " ".join(f"w{rnd.random()}" for _ in range(60))
    first, index = new(), S.FingerprintIndex(35, most_runs=2)
    assert index.append(make_docs([first, new()])).count() == 0
    assert index.append(make_docs([new()])).count() == 0
    assert index.append(make_docs(["x " + first])).count() > 0
    assert len(index.runs) == 1
    assert index.append(make_docs([first])).count() > 0
    assert index.repeated().count() >= 2
    index.drop()


def test_more_repeats_than_are_broadcast(spark, make_docs, odd_texts, monkeypatch):
    monkeypatch.setattr(S, "MOST_SHIPPED", 0)
    texts = odd_texts[:8] + corpus(0)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in S.without_repeats(make_docs(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 35)


def test_runs_merge_without_a_shuffle(spark, make_docs):
    index = S.FingerprintIndex(35)
    for k in range(2):
        index.append(make_docs([" ".join(f"w{k}.{i}" for i in range(80))]))
    a, b = index.runs
    plan = a.select("fp").hint("merge").join(b.select("fp"), "fp")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    index.drop()
