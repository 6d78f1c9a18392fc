import re
from collections import Counter, defaultdict

import pytest

from lumenweir.llm import mixing as M


def simulate(shares, period):
    """Earliest deadline first over one period, slot by slot."""
    done = dict.fromkeys(shares, 0)
    for t in range(period):
        ready = [(-(-(done[s] + 1) * period // p), s) for s, p in shares.items() if done[s] < p and done[s] * period // p <= t]
        assert ready, "no released block"
        deadline, s = min(ready)
        assert t < deadline, "missed"
        yield s, done[s], t
        done[s] += 1


def some_docs(make_docs, sizes):
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i, f"text {i}", s))
            i += 1
    return make_docs(rows)


@pytest.mark.parametrize(("sizes", "targets", "period"), [({"a": 70, "b": 20, "c": 9, None: 3, "": 2}, None, 50), ({"a": 5, "b": 50}, {"a": 0.5, "b": 0.5}, 7), ({"a": 40, "b": 40, "c": 40}, {"a": 3, "b": 1}, 20), ({"a": 10, "b": 3}, {}, 11), ({"one": 9}, None, 10)])
def test_schedule_equals_simulation(spark, make_docs, sizes, targets, period):
    docs = some_docs(make_docs, sizes)
    one = M.shares(docs, targets, period)
    shares = {s.key: s.p for s in one.collect()[0].sources}
    assert sum(shares.values()) == period and min(shares.values()) >= 1
    got = sorted((r.key, r.k, r.t) for r in M.schedule(one, period).collect())
    assert got == sorted(simulate(shares, period))


def test_mix_is_whole_and_on_target(spark, make_docs):
    sizes = {"a": 400, "b": 130, "c": 70, None: 40}
    docs = some_docs(make_docs, sizes)
    out = M.mixed(docs, None, block_rows=4, period=40)
    assert out.columns == [*docs.columns, "mix"]
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == list(range(640))
    share = {r.source: r.mix.share for r in rows}
    places = defaultdict(set)
    for r in rows:
        assert r.mix.release <= r.mix.slot < r.mix.deadline
        places[r.mix.slot].add((r.source, r.mix.block))
    assert all(len(v) == 1 for v in places.values())
    assert len({(r.mix.slot, r.mix.place) for r in rows}) == 640
    ends = {s: -(-n // 4) * 40 // share[s] for s, n in sizes.items()}
    run = Counter()
    for slot in range(min(ends.values())):
        ((source, _),) = places[slot]
        run[source] += 1
        for s in sizes:
            assert abs(run[s] - (slot + 1) * share[s] / 40) < 1
    assert {r.doc_id for r in rows if r.mix.on_target} == {r.doc_id for r in rows if r.mix.slot < min(ends.values())}


def test_more_sources_than_a_schedule_takes_share_lanes(spark, make_docs, monkeypatch):
    for name, value in {"MOST_SOURCES": 12, "LANE_SOURCES": 4}.items():
        monkeypatch.setattr(M, name, value)
    sizes = {f"s{i}": 12 + i % 7 for i in range(60)} | {"large": 900, None: 30, "": 5}
    docs = some_docs(make_docs, sizes)
    rows = M.mixed(docs, block_rows=2).collect()
    assert sorted(r.doc_id for r in rows) == list(range(docs.count()))
    places = defaultdict(set)
    for r in rows:
        assert r.mix.release <= r.mix.slot < r.mix.deadline
        places[r.mix.slot].add(r.source)
    assert all(len(v) == 1 for v in places.values())
    assert len({(r.mix.slot, r.mix.place) for r in rows}) == len(rows)
    weight = {s: n**M.POWER for s, n in sizes.items()}
    total = sum(weight.values())
    end = min(r.mix.slot for r in rows if not r.mix.on_target)
    assert end > 100 and set(range(end)) <= set(places)
    run = Counter()
    for slot in range(end):
        (source,) = places[slot]
        run[source] += 1
        # two blocks by the schedules, and what whole slots of the two periods differ from the weights
        assert all(abs(run[s] - (slot + 1) * w / total) < 2 + 0.06 * (slot + 1) * w / total for s, w in weight.items())


def test_period_grows_with_the_sources(spark, make_docs):
    sizes = {f"s{i}": 1 for i in range(99)} | {"large": 300}
    share = {r.source: r.mix.share for r in M.mixed(some_docs(make_docs, sizes), {"large": 1.0}).collect()}
    assert share["large"] == 40 * 100 - 99 and set(share.values()) == {1, 3901}


def test_edges(spark, make_docs):
    docs = make_docs([(None, None, None), (None, None, None), (1, "", "a"), (1, "", "a")])
    assert M.mixed(docs).count() == 4
    assert M.mixed(docs.limit(0)).count() == 0
    plan = M.mixed(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
