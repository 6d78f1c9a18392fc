import random
import zlib
from hashlib import sha256

import pytest

from lumenweir.llm import trie as T

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, path string, key string, part string, chars string"


def table(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * 5) for r in rows], SCHEMA)


def grown(rows, every=100, most=6):
    """conv_id -> rebuilt turns ((role, text), ...) of rows (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        out[c] = tuple(own.get(c - c % every, [])[:h] + turns[h:])
    return out


def brute(paths):
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    kids = {p: [q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p] for p in members}
    out = []

    def sums(p):
        below = [sums(q) for q in kids[p]]
        leaves = sum(x[0] for x in below) or 1
        saved = sum(x[1] for x in below) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        ends = ",".join(map(str, sorted(c for c in members[p] if len(paths[c]) == len(p))))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves, saved, sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if members:
        sums(())
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select(*T.COLUMNS).collect()), key=str)


def random_rows(seed, convs=240, longest=9, words=3):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(4 * convs), convs):
        n = rnd.choice([0, 1, 2, 3, longest])
        rows += [(c, t, rnd.choice(["user", "assistant", None, ""]) if words > 3 else "user", rnd.choice(["é" * k for k in range(words)] + [None])) for t in range(max(n, 1))]
    rnd.shuffle(rows)
    return rows + [(None, 1, "user", "lost")]


@pytest.mark.parametrize(("seed", "part", "run"), [(0, 10**6, 10_000), (1, 40, 16), (2, 7, 5), (3, 300, 9)])
def test_equals_brute_force(spark, seed, part, run, monkeypatch):
    monkeypatch.setattr(T, "PART_TURNS", part)
    monkeypatch.setattr(T, "RUN_ROWS", run)
    monkeypatch.setattr(T, "IDS", 3)
    rows = random_rows(seed, words=2 + seed)
    have = T.prefix_trie(T.rebuilt(T.sequences(table(spark, rows))))
    assert got(have) == brute(grown(rows))


def test_hot_conversation_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(T, "PART_TURNS", 50)
    monkeypatch.setattr(T, "RUN_ROWS", 20)
    monkeypatch.setattr(T, "IDS", 4)
    rows = [(c, t, "user", f"turn {t}") for c in range(150) for t in range(6)] + [(c, t, "user", f"turn {t}" if t < 4 else f"own {c % 3}") for c in range(150, 190) for t in range(7)]
    seqs = T.sequences(table(spark, rows))
    assert len(T.cuts_of(T.sorted_runs(seqs))) > 5
    assert got(T.prefix_trie(seqs)) == brute(grown(rows, most=1))


def test_long_conversation_null_turns_and_repeats(spark):
    rows = [(5, t, "user", "x" * (t % 3)) for t in range(3000)] + [(6, t, "user", "x" * (t % 3)) for t in range(2999)]
    rows += [(7, None, None, None), (7, 0, "user", "x"), (8, 2, "b", "b"), (8, 2, "b", "b"), (9, 0, "", "")]
    seqs = T.sequences(table(spark, rows))
    have = got(T.prefix_trie(seqs))
    want = grown(rows, most=1)
    assert len(have) == len({p[:d] for p in want.values() for d in range(len(p) + 1)})
    root = next(r for r in have if r[1] == 0)
    assert root[:6] == (5, 0, None, 5, 3, 3)
    assert root[6] == sum(t % 3 for t in range(2999))
    small = [r for r in rows if r[0] > 6]
    assert got(T.prefix_trie(T.sequences(table(spark, small)))) == brute(grown(small, most=1))


def test_empty_table_and_turnless_conversation(spark):
    assert T.prefix_trie(T.sequences(table(spark, []))).count() == 0
    c = next(c for c in range(100, 200) if zlib.crc32(str(c).encode()) % 6 == 5 and c % 100)
    rows = [(c, 0, "user", "gone"), (c + 1000, 0, "user", "x")]
    have = got(T.prefix_trie(T.rebuilt(T.sequences(table(spark, rows)))))
    assert have == brute(grown(rows)) and (c, 0) in {r[:2] for r in have}


def test_loser_tree_does_not_compare_shared_turns_again(monkeypatch):
    rnd = random.Random(1)
    token = lambda: rnd.randbytes(T.TOKEN)
    begin = b"".join(token() for _ in range(500))
    rows = sorted((begin + token(), c) for c in range(400))
    slices = []
    for k in range(8):
        own, last, out = rows[k::8], b"", []
        for path, c in own:
            out.append((path, c, [], T.common(last, path)))
            last = path
        slices.append(iter(out))
    looked = 0

    def common(a, b, known=0, plain=T.common):
        nonlocal looked
        shared = plain(a, b, known)
        looked += shared - known + 1
        return shared

    monkeypatch.setattr(T, "common", common)
    merged = list(T.LoserTree(slices))
    assert [r[:2] for r in merged] == rows
    assert [r[3] for r in merged] == [0] + [500] * 399
    assert looked < 8 * 501 + 400 * 4
