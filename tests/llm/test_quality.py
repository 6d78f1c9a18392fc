import math
import random
import re
from collections import Counter

import numpy as np

from lumenweir.llm import quality as Q


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    wins = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    cov = {i + j for i in range(len(words) - 2) if wins[tuple(words[i : i + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(cov)


def samples():
    rnd = random.Random(4)
    vocab = ["a", "b", "é", "😀x", "###", "<p>", "\n", "\n\n", " ", "\t", "\x0b", "|", "\xa0", "漢 字", "c\nc\nc"]
    return ["".join(rnd.choice(vocab) + rnd.choice(["", " "]) for _ in range(rnd.randint(0, 60))) for _ in range(400)]


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def verdicts(docs, lab):
    return {r.doc_id: r.q for r in docs.select("doc_id", Q.quality_rules(docs, lab).alias("q")).collect()}


def test_base_counts_equal_brute_force(spark, make_docs, odd_texts):
    texts = odd_texts + samples()
    got = verdicts(make_docs(texts), labels(spark, [(20, 1, 0), (None, 1, 0), (20, 1, 0)]))
    for i, t in enumerate(texts):
        want = brute(t or "")
        assert tuple(got[i][k] for k in Q.COUNTS) == want, (i, t)
        assert got[i].base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_scores_equal_brute_force(spark, make_docs):
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice(["the", "thing", "ended", "éla"]) + (rnd.choice(["***", "$$$"]) if i % 3 == 0 else "") for _ in range(60 + i)) for i in range(30)]
    docs, lab = make_docs(texts + [""]), labels(spark, [(i, int(i % 3 != 0), 0) for i in range(20)])
    got = verdicts(docs, lab)

    def bucket(b):
        return (int.from_bytes(b, "little") * 2654435761 % 2**32) >> 16

    def buckets(t):
        b = t.encode()
        return [bucket(b[i : i + 4]) for i in range(len(b) - 3)]

    raw = Counter(x for t in texts for x in buckets(t))
    good = Counter(x for i, t in enumerate(texts[:20]) if i % 3 for x in buckets(t))
    n, m = sum(good.values()), sum(raw.values())
    for i, t in enumerate(texts):
        s = [math.log(good[x] + 1) - math.log(raw[x] * n / m + 1) for x in buckets(t)]
        assert math.isclose(got[i].score, sum(s) / len(s), abs_tol=1e-9)
        assert got[i].kept == (not got[i].base_failed and got[i].score >= Q.THRESHOLD)
    assert got[30].score == 0 and not got[30].kept


def test_no_labels_and_empty_table(spark, make_docs):
    docs = make_docs(["word%d other thing " % i * 20 for i in range(3)] + [" ".join(f"w{i}" for i in range(80))])
    none = labels(spark, [])
    got = verdicts(docs, none)
    assert [got[i].kept for i in range(4)] == [False, False, False, True] and all(g.score == 0 for g in got.values())
    assert verdicts(docs.limit(0), none) == {}


def test_target_counts_every_trusted_document(spark, monkeypatch):
    """All of 20,500 documents are trusted, so target and raw corpus are the same and every score is 0; broadcast or joined."""
    docs = spark.range(20_500).selectExpr("id AS doc_id", "concat('word', md5(string(id))) AS text")
    every = docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    half = every.withColumn("quality", (every["doc_id"] % 2).cast("int"))
    assert {q.score for q in verdicts(docs, every).values()} == {0.0}
    shipped = verdicts(docs, half)
    monkeypatch.setattr(Q, "MOST_SHIPPED", 10)
    assert verdicts(docs, half) == shipped


def test_held_out_labels(spark):
    """The verdict agrees with quality labels that the model was not fitted on."""
    d = "/root/testdata/sf0.01"
    docs, lab = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    odd = "pmod(xxhash64(doc_id), 4) = 0"
    fit, held = lab.filter(f"NOT {odd}"), {r.doc_id: r.quality for r in lab.filter(odd).collect()}
    got = verdicts(docs, fit)
    right = [got[i].kept == bool(q) for i, q in held.items() if not (q and got[i].base_failed)]
    assert np.mean(right) > 0.98
