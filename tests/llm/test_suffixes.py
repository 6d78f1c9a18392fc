import random
from hashlib import sha256

import numpy as np
import pytest

from lumenweir.llm import suffixes as S


def brute(rows, size):
    """(n_bytes, removed runs, kept bytes) of each (doc_id, text)."""
    order = lambda x: (x is not None, x or 0)
    first = {}
    bodies = [(i, (t or "").encode()) for i, t in rows]
    for i, b in bodies:
        for p in range(len(b) - size + 1):
            s = b[p : p + size]
            first[s] = min(first.get(s, order(i)), order(i))
    out = []
    for i, b in bodies:
        gone = np.zeros(len(b) + 2, bool)
        for p in range(len(b) - size + 1):
            if first[b[p : p + size]] < order(i):
                gone[p + 1 : p + 1 + size] = True
        flips = np.flatnonzero(gone[1:] != gone[:-1])
        spans = tuple(zip(flips[0::2].tolist(), flips[1::2].tolist(), strict=True))
        out.append((len(b), spans, bytes(x for x, g in zip(b, gone[1:], strict=False) if not g)))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    letters = "ab" if seed == 2 else "abcdefgh é漢😀"
    shared = ["".join(rnd.choice(letters) for _ in range(rnd.randint(30, 200))) for _ in range(8)]
    texts = ["".join(rnd.choice(shared)[rnd.randint(0, 30) :] if rnd.random() < 0.5 else rnd.choice(letters) * rnd.randint(1, 9) for _ in range(rnd.randint(0, 9))) for _ in range(80)]
    return texts + ["x" * 49, "x" * 50, "x" * 300, "y" * 51, "y" * 49, texts[3], texts[3], texts[7] + "!"]


def got(df):
    return [(r.n_bytes, tuple((s.start, s.end) for s in r.removed), bytes(r.kept)) for r in df.orderBy("doc_id", "n_bytes").collect()]


@pytest.mark.parametrize("v", [*S.COVERS])
def test_covers_have_every_difference(v):
    assert {(a - b) % v for a in S.COVERS[v] for b in S.COVERS[v]} == set(range(v))


@pytest.mark.parametrize("seed", [0, 1, 2])
@pytest.mark.parametrize("size", [50, 6])
def test_equals_brute_force(spark, make_docs, odd_texts, seed, size, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_BYTES", 500 if seed else 1 << 22)
    monkeypatch.setattr(S, "BUCKET_NAMES", 100)
    texts = odd_texts[:8] + [t and t[:3000] for t in odd_texts[8:]] + corpus(seed)
    rows = list(enumerate(texts))
    random.Random(seed).shuffle(rows)
    assert got(S.without_repeated_bytes(make_docs(rows), size)) == brute(sorted(rows), size)


def test_repeated_and_null_ids_of_many_blocks(spark, make_docs, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_BYTES", 100)
    rnd = random.Random(4)
    line = lambda: "".join(rnd.choice("abcdefgh") for _ in range(80))
    a, b = line(), line()
    rows = [(None, a), (None, a + "z"), (1, a + b), (5, b), (5, b), (5, b + a), (5, "q" + b), (5, line()), (7, b + "w")]
    have = S.without_repeated_bytes(make_docs(rows)).collect()
    want = brute(rows, 50)
    key = lambda i, x: (i is not None, i or 0, *x)
    assert sorted(key(r.doc_id, (r.n_bytes, tuple((s.start, s.end) for s in r.removed), bytes(r.kept))) for r in have) == sorted(key(i, x) for (i, _), x in zip(rows, want, strict=True))


def test_very_long_text_and_empty_table(spark, make_docs, odd_texts):
    long = odd_texts[8]
    rows = [(0, "a" + long), (1, long), (2, long[1000:] + "!"), (3, "")]
    have = [(r.n_removed, len(r.removed)) for r in S.without_repeated_bytes(make_docs(rows)).orderBy("doc_id").collect()]
    n = len(long.encode())
    assert have == [(0, 0), (n, 1), (len(long[1000:].encode()), 1), (0, 0)]
    assert S.without_repeated_bytes(make_docs(rows).limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect())
    want = [(i, n, sum(z - a for a, z in s), len(s), sha256(k).hexdigest()) for (i, _), (n, s, k) in zip(rows, brute(rows, 50), strict=True)]
    assert sorted(tuple(r) for r in S.op13_suffix_dedup(spark, d).collect()) == want


def test_texts_stay_where_they_are(spark, make_docs):
    docs = make_docs(["a" * 60, "b" * 70]).select("doc_id", "doc_id", "text").toDF("doc_id", "key", "text")
    whole, n = S.block_table(S.blocked(S.first_copies(docs)))
    assert n == 130
    tied = S.tied_places(whole, 50, 4)
    plan = whole.groupBy("block").cogroup(tied.groupBy("block")).applyInArrow(lambda k, a, b: a, whole.schema)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(block") == 1
    S.dropped_table(whole)


@pytest.mark.parametrize("rows", [[(i, "a" * 60) for i in range(500)], [(i, "short " * 5 + "ab"[i % 2] + "c" * (i % 9)) for i in range(40)], [(i, "x") for i in range(30)]])
def test_batches_without_long_texts(spark, make_docs, monkeypatch, rows):
    """Batches and blocks of copies and of texts shorter than what counts have no names, or ties but nothing to remove."""
    monkeypatch.setattr(S, "DOC_ROWS", 7)
    assert got(S.without_repeated_bytes(make_docs(rows))) == brute(rows, 50)


def test_blocks_of_copies_end(spark, make_docs, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_BYTES", 6400)
    docs = make_docs([(i, "a" * 60) for i in range(3000)]).select("doc_id", "doc_id", "text").toDF("doc_id", "key", "text")
    rows = S.blocked(S.first_copies(docs).coalesce(1)).groupBy("block").count().collect()
    assert sum(r["count"] for r in rows) == 3000 and max(r["count"] for r in rows) <= 100
