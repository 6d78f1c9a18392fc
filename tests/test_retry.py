import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumenweir.streaming import retry as R

KEYS = "query_id bigint, label string"


def rule(rows, most, wait):
    """(ended episodes, keys with an open one) of rows (query_id, event_id, ts, status)."""
    out, state = [], {}
    last = max(r[2] for r in rows)
    for key, event, ts, status in sorted((r for r in rows if r[0] is not None), key=lambda r: r[1]):
        first, _, n, at = state.pop(key, (event, event, 0, ts))
        if n and ts - at > wait:
            out.append((key, first, _, n, "gave_up"))
            first, n = event, 0
        if status != "invalid" or n + 1 >= most:
            out.append((key, first, event, n + 1, status if status != "invalid" else "exhausted"))
        else:
            state[key] = (first, event, n + 1, ts)
    out += [(k, f, e, n, "gave_up") for k, (f, e, n, at) in state.items() if last - at > wait]
    return sorted(out), {k for k, (_, _, _, at) in state.items() if last - at <= wait}


def test_episodes_and_eviction(spark):
    rnd = random.Random(2)
    at, rows = datetime(2024, 1, 1), []
    for i in range(400):
        at += timedelta(minutes=rnd.randint(1, 30))
        rows.append((rnd.choice([None, *range(25)]), i, at, rnd.choice(["invalid", "invalid", "invalid", "accepted", "disagreed"])))
    log = spark.createDataFrame(rows, "query_id bigint, event_id bigint, ts timestamp, status string")
    rows = [(r.query_id, r.event_id, r.ts, r.status) for r in log.collect()]
    got, progress = R.replayed_episodes(log, 4, timedelta(hours=5), slices=5)
    want, still = rule(rows, 4, timedelta(hours=5))
    assert sorted(tuple(r) for r in got.collect()) == want
    assert sum(p["rows"] for p in progress) == 400
    # state is one row of a value and three of a timer for each open key, and nothing for keys whose episodes ended
    assert progress[-1]["state"] <= 4 * len(still) < 4 * 25
    assert {"gave_up", "exhausted", "accepted"} <= {r[4] for r in want}


def calls(log):
    return sorted((r.query_id, r.attempt, r.status) for r in log.collect())


def test_rounds_continue_their_own_run_only(spark, tmp_path):
    keys = spark.createDataFrame([(i, "a") for i in range(30)], KEYS)
    status = F.when((F.col("query_id") + F.col("next_attempt")) % 3 > 0, "invalid").otherwise("accepted")
    call, at = R.hashed_calls(status), str(tmp_path / "run")
    want = sorted((i, a, "invalid" if (i + a) % 3 else "accepted") for i in range(30) for a in range(1, 5) if all((i + b) % 3 for b in range(1, a)) and a <= 2)
    log, why = R.retry_rounds(keys, call, at, {"model": "m"}, 2, most_calls=17)
    assert (why, log.count()) == ("capped", 17)
    log, why = R.retry_rounds(keys, call, at, {"model": "m"}, 2)
    assert why == "complete" and calls(log) == want
    again, why = R.retry_rounds(keys, call, at, {"model": "m"}, 2)
    assert why == "complete" and calls(again) == want
    with pytest.raises(ValueError, match="another run"):
        R.retry_rounds(keys, call, at, {"model": "other"}, 2)
    with pytest.raises(ValueError, match="another run"):
        R.retry_rounds(keys.filter("query_id > 0"), call, at, {"model": "m"}, 2)


def test_refused_calls_use_no_attempt_and_stop(spark, tmp_path):
    keys = spark.createDataFrame([(i, "a") for i in range(6)], KEYS)
    at = str(tmp_path / "run")
    log, why = R.retry_rounds(keys, R.hashed_calls(F.lit("accepted"), F.col("query_id") == 3), at, {}, 3)
    assert why == "stopped" and log.filter("NOT usable").count() == 1
    log, why = R.retry_rounds(keys, R.hashed_calls(F.lit("accepted")), at, {}, 3)
    assert why == "complete" and calls(log.filter("usable")) == [(i, 1, "accepted") for i in range(6)]


def test_no_keys(spark, tmp_path):
    log, why = R.retry_rounds(spark.createDataFrame([], KEYS), R.hashed_calls(F.lit("accepted")), str(tmp_path / "run"), {}, 3)
    assert why == "complete" and log.count() == 0
