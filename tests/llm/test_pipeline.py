import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
from pyspark.sql import functions as F

from lumenweir.llm import mixing


def shingle_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def write(spark, tmp_path, rows, labels):
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")


def test_stages_against_brute_force(spark, tmp_path):
    rnd = random.Random(6)
    texts = []
    for i in range(160):
        w = [rnd.choice(["the", "thing", "ended", "éla", "of", "stone", "river"]) + str(rnd.randint(0, 99)) for _ in range(rnd.randint(60, 160))]
        texts.append((" ".join(w), True))
        if i % 4 == 0:
            texts.append((" ".join(w), True))
        if i % 5 == 0:
            texts.append((" ".join([*w[:-1], "changed"]), True))
        if i % 6 == 0:
            texts.append((" ".join(x + "***" for x in w), False))
    texts += [("too short", None), (None, None), ("", None), ("again and again " * 40, None)]
    rows = [(i, t, "en", rnd.choice(["s0", "s0", "s1", "s2"]), 0) for i, (t, _) in enumerate(texts)]
    write(spark, tmp_path, rows, [(i, int(g), 0) for i, (_, g) in enumerate(texts) if g is not None and i % 2])
    d = str(tmp_path)

    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = []
    for _, stage in corpus_pipeline.STAGES[:4]:
        columns = docs.columns
        docs = spark.createDataFrame(stage(spark, docs, d).collect(), docs.schema)
        assert docs.columns == columns
        out.append(docs.collect())
    quality, exact, near, mix = out

    good = {i for i, (_, g) in enumerate(texts) if g}
    assert {r.doc_id for r in quality} == good
    by_text = defaultdict(list)
    for r in quality:
        by_text[r.text].append(r.doc_id)
    assert sorted(r.doc_id for r in exact) == sorted(max(v) for v in by_text.values())
    sets = {r.doc_id: shingle_set(r.text) for r in exact}
    left, root = sorted(sets), {i: i for i in sets}
    for k, i in enumerate(left):
        for j in left[k + 1 :]:
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = {x: min(a, b) if y in (a, b) else y for x, y in root.items()}
    assert sorted(r.doc_id for r in near) == sorted(set(root.values()))
    assert len(near) < len(exact) < len(quality)
    want = {r.doc_id for r in near}
    assert {r.doc_id for r in mix} == want and len(mix) == len(want)
    # in blocks of 32, each source is less than one block from its share of 1000 until one has no block left
    share = {x.key[1:]: x.p for x in mixing.shares(spark.createDataFrame(near, docs.schema)).collect()[0].sources}
    seen, left = Counter(), Counter(r.source for r in near)
    for k, r in enumerate(mix):
        seen[r.source] += 1
        if any(seen[s] == left[s] for s in share):
            break
        assert abs(seen[r.source] - (k + 1) * share[r.source] / 1000) < 2 * 32

    final = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in final} == want
    seqs = defaultdict(list)
    for r in final:
        seqs[r.sequence_id].append((r.offset, r.length))
    for v in seqs.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 2048


def test_empty_and_all_rejected(spark, tmp_path):
    write(spark, tmp_path, [(1, None, None, None, None), (1, None, None, None, None)], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "source_mix", "best_fit_packing"]
    assert all(re.fullmatch(r"\w+", n) for n, _ in corpus_pipeline.STAGES)


def test_mix_keeps_all_rows_beside_a_one_row_source(spark):
    docs = spark.range(40_001).selectExpr("id AS doc_id", "'text' AS text", "'en' AS lang", "if(id = 7, 'rare', 'big') AS source", "4L AS n_chars")
    rows = corpus_pipeline.mix(spark, docs, "").select("doc_id").collect()
    assert sorted(r.doc_id for r in rows) == list(range(40_001))


def test_near_stage_takes_pairs_from_0_8(spark):
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(f"{m}{i}" if i in at else x for i, x in enumerate(base)) for m, at in (("a", ()), ("b", range(40, 260, 40)))]
    far = [" ".join(f"{x}.{k}" for x in base) for k in range(2)]
    a, b = map(shingle_set, texts)
    assert 80 <= 100 * len(a & b) / len(a | b) < 85
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts + far)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()) == [0, 2, 3]


def test_near_stage_tells_rows_of_one_id_apart(spark):
    a, b = (" ".join(f"{k}{i}" for i in range(90)) for k in "ab")
    docs = spark.createDataFrame([(1, a, "en", "s", 0), (5, a + " end", "en", "s", 0), (5, b, "en", "s", 0), (None, b + " end", "en", "s", 0), (None, None, "en", "s", 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in corpus_pipeline.near(spark, docs, "").collect()) in ([(0, 0), (1, len(a)), (5, len(b))], [(0, 0), (0, len(b) + 4), (1, len(a))])


def test_extra_columns_with_clashing_names(spark, tmp_path):
    rows = [(i, " ".join(f"w{i}.{k}" for k in range(60)), "en", f"s{i % 2}", 0) for i in range(6)] + [(6, "long " + "x" * 300_000 + " word" * 60, "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name in ("_verdict", "_key", "_rank", "_row", "mix", "verdict", "row", "n", "k", "kept", "_near"):
        docs = docs.withColumn(name, F.lit("clash"))
    spark.createDataFrame([(0, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert [c for c in out.columns if c != "mix"] == [c for c in docs.columns if c != "mix"]
        assert {r.doc_id for r in out.collect()} >= set(range(6))


def test_sequences_follow_the_order_of_the_mix(spark, tmp_path):
    rnd = random.Random(9)
    rows = [(i % 190, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(50, 900))), "en", f"s{i % 3}", i) for i in range(200)]
    rows[7] = (7, " ".join(rnd.choice("abcdefgh") for _ in range(6000)), "en", "s1", 7)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    by_order = {}
    for name, order in (("up", F.asc("n_chars")), ("down", F.desc("n_chars"))):
        docs.repartitionByRange(3, order).sortWithinPartitions(order).write.parquet(f"{tmp_path}/{name}")
        out = corpus_pipeline.pack(spark, spark.read.parquet(f"{tmp_path}/{name}"), "").collect()
        assert Counter((r.doc_id, r.piece) for r in out)[(7, 0)] == 2 and len({r.doc_id for r in out}) == 190
        seqs = defaultdict(list)
        for r in out:
            seqs[r.sequence_id].append((r.offset, r.length))
        for v in seqs.values():
            assert [o for o, _ in sorted(v)] == [sum(n for _, n in sorted(v)[:k]) for k in range(len(v))]
            assert sum(n for _, n in v) <= 2048
        # ids told apart by their row: those that stand twice are left out
        at = {i: (i if name == "up" else 199 - i) for i in range(10, 190)}
        least = [min(at[r.doc_id] for r in out if r.sequence_id == q and r.doc_id in at) for q in sorted(seqs) if all(r.doc_id in at for r in out if r.sequence_id == q)]
        assert least == sorted(least) and len(least) > 10
        by_order[name] = [sorted(r.doc_id for r in out if r.sequence_id == q) for q in sorted(seqs)]
    assert by_order["up"] != by_order["down"]


def test_a_table_that_is_no_scan_is_packed_in_its_order(spark):
    docs = spark.range(40, numPartitions=3).selectExpr("id AS doc_id", "repeat('a b ', 500) AS text", "id % 2 AS k").join(spark.range(2).withColumnRenamed("id", "k"), "k")
    assert sorted({r.doc_id for r in corpus_pipeline.pack(spark, docs, "").collect()}) == list(range(40))
