import dataclasses
import json

import pytest
from pyspark.sql import functions as F

from lumenweir.sources import readers as R
from lumenweir.sources import sinks as S
from lumenweir.streaming import attempt_log as L


def test_corpus_files(spark, tmp_path):
    for folder, name, data in (("PRESENT", "a__hg.sol", b"x"), ("ABSENT", "b.sol", "é".encode()), ("ABSENT", "c.sol", b"\xff\xfe"), ("ABSENT", "d.txt", b"no")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_bytes(data)
    got = [(r.path.split("/")[-1], r.label, r.origin, r.content) for r in R.corpus_files(spark, str(tmp_path)).collect()]
    assert got == [("b.sol", "ABSENT", "pool", "é"), ("c.sol", "ABSENT", "pool", None), ("a__hg.sol", "PRESENT", "hg", "x")]
    with pytest.raises(Exception, match="unexpected file name"):
        R.named_files(spark, str(tmp_path), r"(\w)\.sol", ["kind"]).collect()


def test_jsonl_round_trip_and_missing(spark, tmp_path):
    df = spark.createDataFrame([(2, "é", None), (1, None, 0.5)], "b bigint, a string, c double")
    S.jsonl(df, str(tmp_path / "x"))
    lines = sorted(x for p in (tmp_path / "x").glob("part-*") for x in p.read_text().splitlines())
    assert lines == ['{"a":"é","b":2,"c":null}', '{"a":null,"b":1,"c":0.5}']
    back = R.jsonl(spark, str(tmp_path / "x"), df.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert R.jsonl(spark, str(tmp_path / "none"), "a string").count() == 0
    S.parquet_by(df, str(tmp_path / "p"), "b")
    assert (tmp_path / "p" / "b=2").is_dir()
    S.jsonl_by(df, str(tmp_path / "by"), "b")
    assert (tmp_path / "by" / "by_b=1").is_dir()


def test_event_log(spark, tmp_path):
    lines = [{"type": "turn.completed", "usage": {"in": 3, "out": 1}}, {"type": "turn.completed", "usage": {"in": 4, "out": "x"}}, {"type": "item.done", "item": {"type": "shell"}}, {"type": "item.done", "item": {"type": "reasoning"}}, {"type": "error", "message": "boom"}]
    (tmp_path / "log").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n{\n")
    log = R.event_log(spark, str(tmp_path / "log"))
    assert log.count() == 5
    (r,) = R.event_usage(log, ["in", "out", "cached"]).collect()
    assert (r["in"], r["out"], r["cached"], r["tools"], r["errors"]) == (7, 1, None, ["shell"], ["boom"])


@dataclasses.dataclass
class Config:
    name: str
    data: str
    n: int = 3


def test_config_and_template(tmp_path):
    (tmp_path / "c.json").write_text('{"name": "a", "data": "d/x"}')
    c = R.strict_config(Config, str(tmp_path / "c.json"), ("data",))
    assert c == Config("a", str(tmp_path / "d/x"))
    (tmp_path / "bad.json").write_text('{"name": "a", "data": "d", "other": 1}')
    with pytest.raises(ValueError, match="unknown"):
        R.strict_config(Config, str(tmp_path / "bad.json"))
    (tmp_path / "t").write_text("a <<Q>> b <<Q>>")
    with pytest.raises(ValueError, match="exactly once"):
        R.template(str(tmp_path / "t"), "<<Q>>")


def test_publish_and_markdown(spark, tmp_path):
    at = tmp_path / "out"
    S.publish(str(at), lambda p: (tmp_path / p / "a").write_text("1"))
    S.publish(str(at), lambda p: (tmp_path / p / "b").write_text("2"))
    assert [p.name for p in at.iterdir()] == ["b"] and [p.name for p in tmp_path.iterdir()] == ["out"]
    with pytest.raises(ZeroDivisionError):
        S.publish(str(at), lambda p: 1 / 0)
    assert [p.name for p in at.iterdir()] == ["b"]
    df = spark.createDataFrame([("m", 0.5, None)], "mode string, f1 double, p double")
    assert S.markdown(df, ["mode", "f1", "p"], "T") == "# T\n\n| mode | f1 | p |\n| --- | --- | --- |\n| m | 0.500 | — |\n"


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    log = spark.createDataFrame([(i % 7, i, "invalid" if i % 3 else "accepted") for i in range(60)], "query_id bigint, event_id bigint, status string")
    want = sorted(map(tuple, L.latest_state(log, 5).collect()))
    log.filter("event_id < 40").repartition(4).write.json(str(tmp_path / "log"))
    run = lambda: L.run_available(L.latest_state(L.log_stream(spark, str(tmp_path / "log"), log.schema), 5), str(tmp_path / "out"))
    run()
    S.append_log(log.filter("event_id >= 40"), str(tmp_path / "log"))
    run()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out/state")).collect())) == want


def test_sessions(spark):
    e = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (1, "2024-01-01 02:00:00")], "user_id int, t string").select("user_id", F.to_timestamp_ntz("t").alias("ts"))
    assert sorted(r.attempts for r in L.sessions(e).collect()) == [1, 2]


def test_versions_are_whole_and_checked(spark, tmp_path):
    at = str(tmp_path / "published")
    with pytest.raises(FileNotFoundError):
        S.current_version(spark, at)
    one = S.commit_version(spark, at, {"a": spark.range(5), "b": spark.range(3)})
    two = S.commit_version(spark, at, {"a": spark.range(7), "b": spark.range(2)})
    assert S.current_version(spark, at) == two
    assert [S.read_version(spark, at, t).count() for t in "ab"] == [7, 2]
    assert S.read_version(spark, at, "a", one).count() == 5

    with pytest.raises(Exception, match="assert_true|went wrong|USER_RAISED"):  # a version that fails on the way is never seen
        S.commit_version(spark, at, {"a": spark.range(1), "b": spark.range(1).select(F.raise_error(F.lit("went wrong")).alias("x"))})
    assert S.current_version(spark, at) == two and S.read_version(spark, at, "a").count() == 7
    S.copy_manifest(spark, at, str(tmp_path / "copy"))
    names = [r.name for r in spark.read.json(str(tmp_path / "copy")).collect()]
    assert names == sorted(names) and {n[0] for n in names} == {"a", "b"}
    gone = next((tmp_path / "published" / two / "a").glob("part-*.parquet"))
    gone.rename(str(gone).replace("part-", "port-"))
    with pytest.raises(ValueError, match="missing|unexpected"):
        S.read_version(spark, at, "a")


def test_ring_over_the_whole_order(spark):
    from lumenweir.operators.ranks import next_in_ring

    rows = [("m", k, f"v{k}") for k in (5, 900, -3, 44, 10**12)] + [("one", 1, "x")]
    got = {(r.g, r.k): r.d for r in next_in_ring(spark.createDataFrame(rows, "g string, k bigint, v string"), "g", "k", "v", "d").collect()}
    order = sorted(k for g, k, _ in rows if g == "m")
    assert got == {("m", k): f"v{order[(i + 1) % 5]}" for i, k in enumerate(order)} | {("one", 1): "x"}
    assert next_in_ring(spark.createDataFrame([], "g string, k bigint, v string"), "g", "k", "v", "d").count() == 0
