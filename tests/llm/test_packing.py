import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from lumenweir.llm import packing as K

WORD = P.path("word_bpe_49k.json")


@pytest.mark.parametrize("seed", range(6))
def test_configurations_cover_the_histogram_exactly(seed):
    rnd = random.Random(seed)
    kinds = [lambda: rnd.randint(1, 256), lambda: 256, lambda: int(min(256, rnd.lognormvariate(4, 1))) or 1, lambda: rnd.choice([100, 129, 140]), lambda: rnd.randint(120, 256), lambda: 1]
    hist = Counter(kinds[seed]() for _ in range(rnd.choice([1, 50, 3000])))
    plan = K.configurations(dict(hist), 256)
    assert all(sum(n * m for n, m in c.items()) <= 256 and t > 0 for c, t in plan)
    got = Counter()
    for c, t in plan:
        for n, m in c.items():
            got[n] += m * t
    assert got == hist


def test_near_the_volume_bound():
    rnd = random.Random(8)
    hist = Counter(min(2048, int(rnd.lognormvariate(6, 1)) + 1) for _ in range(20_000))
    bins = sum(t for _, t in K.configurations(dict(hist)))
    assert bins <= 1.005 * sum(n * c for n, c in hist.items()) / 2048 + 1


def test_no_worse_than_first_fit_decreasing_where_lengths_do_not_fill():
    rnd = random.Random(5)
    items = [rnd.choice([900, 1100, 700, 1300, 650]) for _ in range(2000)]
    free = []
    for n in sorted(items, reverse=True):
        for i, f in enumerate(free):
            if f >= n:
                free[i] -= n
                break
        else:
            free.append(2048 - n)
    assert sum(t for _, t in K.configurations(dict(Counter(items)))) <= len(free) * 1.02


def least_sequences(items, capacity):
    """The least number of sequences, by trying every place of every piece."""
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, free):
        if len(free) >= best[0]:
            return
        if i == len(items):
            best[0] = len(free)
            return
        for f in sorted({f for f in free if f >= items[i]}):
            k = free.index(f)
            place(i + 1, [*free[:k], f - items[i], *free[k + 1 :]])
        place(i + 1, [*free, capacity - items[i]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(12))
def test_against_an_exact_solver_and_the_bound(seed):
    rnd = random.Random(seed)
    items = [rnd.randint(3, 16) for _ in range(rnd.randint(1, 11))]
    hist, least = Counter(items), least_sequences(items, 20)
    got = sum(t for _, t in K.configurations(dict(hist), 20))
    assert got == least
    lengths = np.array(sorted(hist))
    _, bound = K.fractional(lengths, np.array([hist[n] for n in lengths.tolist()]), 20)
    assert bound <= least + 1e-9


def histogram(kind, n=20_000):
    rnd = random.Random(1)
    if kind == "lognormal":
        return Counter(min(2048, int(rnd.lognormvariate(5.7, 1)) + 1) for _ in range(n))
    return Counter(rnd.randint(*kind) for _ in range(n))


@pytest.mark.parametrize("kind", ["lognormal", (600, 1100), (400, 800), (1, 2048), (1000, 1000), (1025, 2048)])
def test_never_more_than_best_fit_nor_less_than_the_bound(kind):
    hist = histogram(kind)
    plan, own, bound = K.solved(dict(hist))
    n = sum(t for _, t in plan)
    assert bound <= n + 1e-6 and own <= n <= sum(t for _, t in K.best_fit(dict(hist), 2048))
    have = Counter()
    for config, times in plan:
        assert times > 0 and sum(k * m for k, m in config.items()) <= 2048
        for k, m in config.items():
            have[k] += m * times
    assert have == hist


@pytest.mark.parametrize("kind", ["lognormal", (400, 800)])
def test_sequences_that_fill_come_from_the_program(kind):
    plan, own, bound = K.solved(dict(histogram(kind)))
    n = sum(t for _, t in plan)
    assert n <= 1.01 * bound and own > n / 2


@pytest.mark.parametrize("kind", ["lognormal", (600, 1100), (400, 800)])
@pytest.mark.parametrize("way", K.WAYS)
def test_fractions_cover_no_length_more_than_once(kind, way):
    hist = histogram(kind)
    lengths = np.array(sorted(hist))
    counts = np.array([hist[n] for n in lengths.tolist()])
    use, bound = K.fractional(lengths, counts, 2048, way)
    cover = np.zeros(len(lengths))
    for key, times in use.items():
        assert times > 0 and sum(int(lengths[j]) * m for j, m in key) <= 2048
        for j, m in key:
            cover[j] += times * m
    assert (cover <= counts * (1 + 1e-6)).all()
    # the fractions' sequences and the room that the uncovered rest needs at least are no fewer than the bound, and near it where sequences fill
    left = float((counts - cover) @ lengths) / 2048
    if kind == "lognormal":
        assert bound * (1 - 1e-6) <= sum(use.values()) + left <= 1.01 * bound


def check(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= capacity
    return by


def test_packed_documents(spark, make_docs, odd_texts):
    rnd = random.Random(1)
    texts = odd_texts + [" ".join(["the"] * rnd.randint(0, 90)) for _ in range(300)] + ["the of and"] * 200
    docs = make_docs(texts + [(None, "a b"), (None, "a b"), (7, "again")])
    rows = K.packed_documents(docs, WORD, 64).collect()
    by = check(rows, 64)
    pieces = K.token_pieces(docs, WORD, 64).collect()
    cut = lambda rs: sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rs), key=str)
    assert cut(rows) == cut(pieces)
    assert len(by) <= 1.02 * sum(r.length for r in rows) / 64 + 2
    assert K.packed_documents(docs.limit(0), WORD, 64).count() == 0
