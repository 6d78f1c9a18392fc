import glob
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lumenweir.llm import phrases as P

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, longest, least, top, held):
    """rows (lang, text) -> {lang: [(phrase, a, l, r, n, score)]} in rank order."""
    f, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        own = f.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(AZ)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            own.update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = {}
    for lang, own in f.items():
        good = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + k] for p, a in good.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= held * own[p[i : i + k]]}
        rows = []
        for p, a in good.items():
            if p not in gone:
                score, _, l, r = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
                rows.append((" ".join(p), a, l, r, total[lang], score))
        rows.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        if rows:
            out[lang] = rows[:top]
    return out


def corpus(seed):
    rnd = random.Random(seed)
    words = ["a", "b", "Cc", "é", "É", "漢字", "d\x1ce", "x y", "New", "york"]
    text = lambda: "".join(rnd.choice(words) + rnd.choice([" ", " ", "\t", "  ", ". ", "\n", ", "]) for _ in range(rnd.randint(0, 60)))
    return [(rnd.choice(["en", "de", None, "und"]), text()) for _ in range(90)] + [("en", None), (None, ""), ("fr", "..,,"), ("es", "z " * 500)]


@pytest.mark.parametrize(("longest", "least", "top", "held"), [(4, 3, 2000, 80), (4, 2, 7, 50), (2, 3, 20, 80), (3, 40, 20, 100), (6, 5, 2000, 80)])
def test_equals_brute_force(spark, make_docs, longest, least, top, held, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_BYTES", 600)
    rows = corpus(longest)
    docs = make_docs([(i, t) for i, (_, t) in enumerate(rows)]).drop("lang").join(spark.createDataFrame([(i, x) for i, (x, _) in enumerate(rows)], "doc_id bigint, lang string"), "doc_id")
    got = {}
    for r in P.collocations(docs, longest, least, top, held).orderBy("lang", "rank").collect():
        got.setdefault(r.lang, []).append((r.phrase, r.a, r.l, r.r, r.n, r.score))
        assert r.rank == len(got[r.lang])
    assert got == brute(rows, longest, least, top, held)


def test_counts_do_not_depend_on_the_sieve(spark, make_docs, odd_texts, monkeypatch):
    rows = [("en", t and t[:20_000]) for t in odd_texts] * 2
    docs = make_docs([(i, t) for i, (_, t) in enumerate(rows)])
    want = brute(rows, 4, 6, 50, 80)
    show = lambda df: [(r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.orderBy("rank").collect()]
    assert show(P.collocations(docs, 4, 6, 50)) == want["en"]
    monkeypatch.setattr(P, "sieve", lambda spark, table: spark.sparkContext.broadcast(P.Bitmap(16, np.full(1 << 10, ~np.uint64(0)))))
    assert show(P.collocations(docs, 4, 6, 50)) == want["en"]


def test_products_beyond_64_bits(spark):
    a = 9 * 10**17
    df = spark.createDataFrame([(a, [a, a + 5], [a + 7, a])], "a bigint, firsts array<bigint>, rests array<bigint>").select(P.score().alias("s")).select("s.*")
    r = df.first()
    assert (r.score, r.k, r.l, r.r) == min((2_000_000 * a // (x + y), k, x, y) for k, (x, y) in enumerate([(a, a + 7), (a + 5, a)], 1))


def test_empty_table(spark, make_docs):
    assert P.collocations(make_docs(["a b"]).limit(0)).count() == 0
    assert P.collocations(make_docs([None, "", " "])).count() == 0


def test_phrases_give_parts_and_longer(spark, make_docs):
    rows = P.phrases(make_docs(["x y z"] * 4 + ["x y"]), 3, 4).withColumn("f", F.col("firsts")).collect()
    assert sorted((r.phrase, r.length, r.a, tuple(r.firsts), tuple(r.rests), r.longer, r.n) for r in rows) == [("x y", 2, 5, (5,), (5,), 4, 14), ("x y z", 3, 4, (5, 5), (4, 4), 0, 14), ("y z", 2, 4, (5,), (4,), 4, 14)]


def test_row_groups_of_blocks_stay_small(spark, make_docs, monkeypatch):
    """A task of many blocks writes and reads a few at a time: rows of megabytes would else fill a row group of 100 or more."""
    monkeypatch.setattr(P, "BATCH_ROWS", 1)  # a block of each
    sizes, stored = [], P.stored

    def counted(df, name, *more):
        out = stored(df, name, *more)
        if name == "lists":
            files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{out._lumenweir_path}/*.parquet")]
            sizes.append([m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)])
        return out

    monkeypatch.setattr(P, "stored", counted)
    rows = [(i, "one two three four " * 50) for i in range(120)]
    assert P.phrases(make_docs(rows).coalesce(1), least=30).filter("length = 4").count() > 0
    assert [sum(s) for s in sizes] == [120] * len(sizes) and len(sizes) == 3
    assert max(map(max, sizes)) <= P.BLOCK_ROWS
