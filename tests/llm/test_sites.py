import math
import random

import numpy as np
import pytest

from lumenweir.llm import sites as S


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def small(rnd, i):
    good = rnd.random() < 0.7
    words = [rnd.choice(["the", "thing", "ended", "éla", "of"]) + ("" if good else rnd.choice(["***", "$$$", "!!"])) for _ in range(60 + i % 40)]
    return (i, " ".join(words), rnd.choice(["a", "b", "c", None])), int(good)


def test_posteriors_equal_recomputed_rates(spark, make_docs):
    rnd = random.Random(4)
    rows = [small(rnd, i) for i in range(300)]
    docs, lab = make_docs([r for r, _ in rows] + [(None, None), (5, "", "a")]), labels(spark, [(i, g, 0) for i, (_, g) in enumerate(rows) if i < 200] + [(None, 1, 0), (3, 1, 0), (3, 0, 0)])
    _, _, base = S.fitted(docs, lab)
    out = S.site_quality(docs, lab).collect()
    assert len(out) == 302
    p = [1 / (1 + math.exp(-r.evidence)) for r in out]
    every = sum(p) / len(p)
    host, path = {}, {}
    for r, x in zip(out, p, strict=True):
        host.setdefault(r.host, []).append(x)
        path.setdefault((r.host, r.path), []).append(x)

    def strength(groups, parent):
        n = sum(map(len, groups.values()))
        within = sum((x - np.mean(g)) ** 2 for g in groups.values() for x in g) / max(n - len(groups), 1)
        between = sum(len(g) * (np.mean(g) - parent(k)) ** 2 for k, g in groups.items()) / n
        return min(max(within / max(between - within * len(groups) / n, 1e-12), S.LEAST_STRENGTH), S.MOST_STRENGTH)

    kh = strength(host, lambda _: every)
    rate = {h: (sum(g) + kh * every) / (len(g) + kh) for h, g in host.items()}
    kp = strength(path, lambda k: rate[k[0]])
    for r, x in zip(out, p, strict=True):
        g = path[r.host, r.path]
        want = (sum(g) - x + kp * rate[r.host]) / (len(g) - 1 + kp)
        assert math.isclose(r.host_rate, rate[r.host], rel_tol=1e-6) and math.isclose(r.path_rate, want, rel_tol=1e-6)
        logit = r.evidence - math.log(base / (1 - base)) + math.log(want / (1 - want))
        assert math.isclose(r.posterior, 1 / (1 + math.exp(-logit)), rel_tol=1e-6, abs_tol=1e-9) and r.kept == (r.posterior >= 0.5)


def test_a_sparse_site_stays_near_the_global_rate(spark, make_docs):
    rnd = random.Random(1)
    rows = [small(rnd, i) for i in range(200)]
    bad = " ".join(["bad***"] * 70)
    docs = make_docs([(i, t, "big") for i, ((_, t, _), _) in enumerate(rows)] + [(900, bad, "tiny")] + [(1000 + i, bad + f" {i}", "junk") for i in range(60)])
    lab = labels(spark, [(i, g, 0) for i, (_, g) in enumerate(rows)])
    rates = {r.host: r.host_rate for r in S.site_quality(docs, lab).collect()}
    assert rates["=junk"] < rates["=tiny"] < rates["=big"]


def test_without_labels_and_empty(spark, make_docs):
    docs = make_docs(["a b c", None])
    assert all(r.evidence == 0 and r.kept for r in S.site_quality(docs, labels(spark, [])).collect())
    assert S.site_quality(docs.limit(0), labels(spark, [(1, 1, 0)])).count() == 0


@pytest.mark.parametrize("d", ["/root/testdata/sf0.01"])
def test_held_out_accuracy(spark, d):
    docs, lab = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    odd = "pmod(xxhash64(doc_id), 4) = 0"
    held = {r.doc_id: r.quality for r in lab.filter(odd).collect()}
    got = {r.doc_id: r.kept for r in S.site_quality(docs, lab.filter(f"NOT {odd}")).collect()}
    assert np.mean([got[i] == bool(q) for i, q in held.items()]) >= 0.97
