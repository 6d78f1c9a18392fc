import hashlib
import random
import re

from pyspark.sql import functions as F

from lumenweir.llm import exact as E


def test_groups_equal_brute_force(spark, make_docs, odd_texts):
    rnd = random.Random(2)
    long = "".join(rnd.choice("ab c.,\n") for _ in range(20_000))
    texts = [*odd_texts, long, long, long[:-1] + "z", "z" + long, None, "é", "é"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (40, "same"), (40, "same"), (40, "other"), (None, "same"), (None, "null only"), (None, "null only")]
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in E.exact_groups(make_docs(rows)).collect()), key=str)
    want, seen = [], set()
    for i, t in rows:
        same = [j for j, u in rows if (u or "") == (t or "")]
        keep = max((j for j in same if j is not None), default=None)
        kept = i == keep and (t or "") not in seen
        if kept:
            seen.add(t or "")
        want.append((i, keep, len(same), kept, hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_chunks_rejoin_and_follow_content(spark, make_docs, odd_texts):
    rnd = random.Random(3)
    long = "".join(rnd.choice("abcdefg .,\n😀") for _ in range(30_000))
    texts = [t or "" for t in odd_texts] + [long, "xx" + long]
    rows = make_docs(texts).withColumn("c", E.chunks(F.col("text"))).collect()
    by = {r.doc_id: list(r.c) for r in rows}
    assert all("".join(by[i]) == t for i, t in enumerate(texts))
    assert all(len(c) <= E.MAX_CHUNK for cs in by.values() for c in cs)
    a, b = set(by[len(texts) - 2]), set(by[len(texts) - 1])
    assert len(a & b) >= len(a) - 2  # two more characters in front change the first chunk or two


def test_a_shared_identifier_is_found(spark, make_docs, monkeypatch):
    real = E.named
    monkeypatch.setattr(E, "named", lambda c, salt: real(c, salt) if salt else F.struct(F.length(c).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b")))
    docs = make_docs(["abc", "abd", "abc"])
    assert E.verified_salt(docs) == 1
    assert sorted((r.doc_id, r.keep_id) for r in E.exact_groups(docs).collect()) == [(0, 2), (1, 1), (2, 2)]


def test_without_copies_keeps_whole_rows(spark, make_docs):
    rows = [(1, "a"), (2, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (5, "c"), (None, "d"), (None, "d")]
    docs = make_docs(rows)
    out = E.without_copies(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(2, "a"), (4, ""), (5, "b"), (5, "c"), (None, "d")], key=str)
    assert E.without_copies(docs.limit(0)).count() == 0 and E.exact_groups(docs.limit(0)).count() == 0


def test_query_equals_its_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    rel = con.sql(E.SQL["op9_exact_dedup"])
    got = E.op9_exact_dedup(spark, d)
    assert sorted(map(tuple, got.select(*rel.columns).collect())) == sorted(rel.fetchall())
    plan = got._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
