import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumenweir import __main__ as cli
from lumenweir.functions import reports as R
from lumenweir.operators import manifest as N
from lumenweir.plans import release as L

CONFIG = L.ReleaseConfig(excluded_origins=("hg",), leak_text="_leak_", most_tokens=400, min_tokens=20)


def contract(rnd, i):
    names = [f"v{rnd.randint(0, 10**6)}" for _ in range(12)]
    body = " ".join(f"uint {n} = {rnd.choice(names)} {rnd.choice('+-*/')} {rnd.randint(0, 9)}{rnd.choice([';', ' ; if (true) {{ }}', ' ** 2;'])}" for n in names)
    return f"pragma solidity ^0.{4 + i % 3}.1;\ncontract C{i} {{ // note {i}\n{body} }}"


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(120):
        rows.append([i, "ab"[i % 2], "PRESENT" if rnd.random() < 0.4 else "ABSENT", "pool", contract(rnd, i)])
    rows += [[200, "a", rows[0][2], "pool", rows[0][4].replace("note", "other")], [201, "a", "PRESENT" if rows[1][2] == "ABSENT" else "ABSENT", "pool", rows[1][4]], [202, "a", "PRESENT", "hg", "x"], [203, "a", "PRESENT", "pool", None], [204, "a", "PRESENT", "pool", "/* open"], [205, "b", "ABSENT", "pool", "int _leak_1;"], [206, "b", "ABSENT", "pool", "x " * 500]]
    rows.append([207, "a", rows[2][2], "pool", rows[2][4].replace("contract C2", "contract Renamed")])
    return spark.createDataFrame(rows, "path bigint, collection string, label string, origin string, content string")


def test_release(spark, corpus):
    r = L.build_release(corpus, CONFIG)
    rows, gone = r.rows.collect(), {x.path: x.reason for x in r.exclusions.collect()}
    assert len(rows) + len(gone) == corpus.count() and not {x.query_id for x in rows} & set(gone)
    assert {k: gone[k] for k in (1, 200, 201, 202, 203, 204, 205, 206)} == {1: "conflicting_duplicate", 200: "duplicate", 201: "conflicting_duplicate", 202: "excluded_origin", 203: "unreadable_source", 204: "unreadable_source", 205: "label_leaking_identifiers", 206: "overlength_source"}
    by = {x.query_id: x for x in rows}
    for x in rows:
        y = by[x.match_partner]
        assert y.match_partner == x.query_id and y.label != x.label and (y.partition, y.collection) == (x.partition, x.collection)
    parts = {}
    for x in rows:
        assert parts.setdefault(x.group_id, x.partition) == x.partition
    assert (2, 207, "exact_skeleton") in {(e.left, e.right, e.reason) for e in r.edges.collect()}
    counts = Counter((x.partition, x.collection, x.label) for x in rows)
    assert all(x.n == counts[x.partition, x.collection, x.label] for x in r.statistics.collect())
    assert rows[0].source.startswith("0001 | pragma") and "note" not in rows[0].source


def test_release_with_a_split_search(spark, corpus):
    from dataclasses import replace

    config = replace(CONFIG, split_seeds=(42, 61), least_groups=(5, 1, 4))
    r = L.build_release(corpus, config)
    rows, tried = r.rows.collect(), r.split_attempts.collect()
    chosen = {x.seed for x in tried if x.chosen}
    assert "split_attempts" in r.names and len(chosen) == 1 and {x.seed for x in tried} == set(range(42, 62))
    assert all(x.passed for x in tried if x.chosen)
    groups, cells = {}, Counter((x.partition, x.collection, x.label) for x in rows)
    for x in rows:
        groups.setdefault((x.partition, x.label), set()).add(x.group_id)
    assert len(cells) == 12 and all(len(v) >= dict(train=5, validation=1, test=4)[p] for (p, _), v in groups.items())
    with pytest.raises(ValueError, match="no seed from 42 to 43"):
        L.build_release(corpus, replace(config, split_seeds=(42, 43), least_groups=(5, 1, 400)))


def test_training_records(spark, corpus):
    rows = L.build_release(corpus, CONFIG).rows
    report = lambda v: F.concat(F.lit('{"analysis":"why","verdict":"'), v, F.lit('","location":'), F.when(v == "PRESENT", '{"start_line":1,"end_line":1,"function":null}').otherwise("null"), F.lit("}"))
    log = rows.select("query_id", F.lit(2).alias("seq"), F.when(F.col("query_id") % 9 == 0, "disagreed").otherwise("accepted").alias("status"), report(F.col("label")).alias("report"))
    log = log.unionByName(rows.select("query_id", F.lit(1).alias("seq"), F.lit("invalid").alias("status"), F.lit(None).cast("string").alias("report")))
    records, gone = L.build_training_records(rows, log, {"label": "One word.", "report": "Explain."}, 10_000)
    got, out = records.collect(), {r.query_id: r.reason for r in gone.collect()}
    train = {r.query_id: r for r in rows.filter("partition = 'train'").collect()}
    broken = {i for i, r in train.items() if i % 9 == 0 or r.match_partner % 9 == 0}
    assert set(out) == broken and {i for i, why in out.items() if why == "teacher_disagreed"} == {i for i in train if i % 9 == 0}
    assert Counter(r.id for r in got) == {i: 2 for i in train if i not in broken}
    for r in got:
        said = r.completion[0].content
        assert said == r.label if r.condition == "label" else json.loads(said)["verdict"] == r.label
        assert r.sequence_tokens == r.prompt_tokens + r.completion_tokens


def test_evaluate_needs_full_coverage(spark):
    gold = spark.createDataFrame([(i, "PRESENT" if i % 2 else "ABSENT", "a", f"g{i % 4}") for i in range(12)], "id bigint, gold string, collection string, group_id string")
    p = gold.select("id", F.explode(F.array(F.lit("x"), F.lit("y"))).alias("mode"), F.col("gold").alias("predicted"))
    out = L.evaluate(p, gold, [("x", "y")], draws=20)
    assert {r.macro_f1 for r in out["scores"].collect()} == {1.0} and out["intervals"].count() == 3
    with pytest.raises(ValueError, match="miss 1"):
        L.evaluate(p.filter("NOT (mode = 'x' AND id = 3)"), gold)


def test_schemas_and_keys(spark):
    assert list(R.report_schema("verdict_first")["properties"]) == ["verdict", "analysis", "location"]
    assert R.answer_schema()["additionalProperties"] is False
    assert N.settings_key({"b": 1, "a": 2}) == N.settings_key({"a": 2, "b": 1}) != N.settings_key({"a": 3, "b": 1})
    assert N.environment(spark)["spark"]


def test_command(capsys):
    assert cli.main(["--list"]) == 0 and "macro_f1" in capsys.readouterr().out
    assert cli.main(["nothing"]) == 1


def test_commands_on_files(spark, corpus, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    corpus.write.parquet(at("corpus"))
    (tmp_path / "config.json").write_text(json.dumps({"min_tokens": 20, "most_tokens": 400}))
    assert cli.main(["build_release", "--data", at("corpus"), "--out", at("release"), "--config", at("config.json")]) == 0
    rows = spark.read.parquet(at("release") + "/rows")
    assert rows.count() and spark.read.parquet(at("release") + "/exclusions").count()
    assert cli.main(["prompts", "--data", at("release") + "/rows", "--split", "train", "--pilot", "2", "--max-invocations", "3", "--out", at("pilot")]) == 0
    assert spark.read.parquet(at("pilot")).count() <= 3
    for wrong in (["--split", "test"], ["--split", "train", "--ceiling"], ["--split", "validation", "--pilot", "2"]):
        with pytest.raises(ValueError):
            cli.main(["prompts", "--data", at("release") + "/rows", "--out", at("none"), *wrong])
    assert cli.main(["schemas", "--out", at("schemas")]) == 0
    asked = ["prompts", "--data", at("release") + "/rows", "--split", "train", "--out", at("asked"), "--schema"]
    assert cli.main([*asked, at("schemas") + "/answer.json"]) == 0
    for wrong in ("report_analysis_first.json", "none.json"):
        with pytest.raises(ValueError, match="stale"):
            cli.main([*asked, f"{at('schemas')}/{wrong}"])
    assert cli.main(["evaluate", "--data", at("gold")]) == 1 and "needs --out --predictions" in capsys.readouterr().err


def test_sessions_gates_and_inputs(spark):
    from lumenweir.functions import text as T
    from lumenweir.operators import attempts as A
    from lumenweir.operators import curation as C
    from lumenweir.operators import formatting as Fm

    gold = spark.createDataFrame([(1, "PRESENT"), (2, "ABSENT"), (3, "ABSENT"), (4, "PRESENT")], "q bigint, gold string")
    log = spark.createDataFrame([(1, 1, "invalid", None), (1, 2, "accepted", "PRESENT"), (2, 1, "disagreed", "PRESENT"), (3, 1, "unsupported", None)], "q bigint, seq bigint, status string, verdict string")
    assert {r.q: r.predicted for r in A.ceiling(gold, log, "q", "seq").collect()} == {1: "PRESENT", 2: "PRESENT", 3: "INVALID", 4: "INVALID"}
    gate = C.cohort_gate(spark.createDataFrame([("PRESENT", "a"), ("PRESENT", "b"), ("PRESENT", "b")], "label string, group_id string"), 2)
    assert {r.label: (r.groups, r.passed) for r in gate.collect()} == {"PRESENT": (2, True), "ABSENT": (0, False)}
    names = spark.createDataFrame([("checkpoint-12",), ("checkpoint-9",), ("last",)], "n string")
    assert [r.k for r in names.select(T.name_number(F.col("n")).alias("k")).collect()] == [12, 9, None]
    records = spark.createDataFrame([(1, 10), (2, 20)], "id bigint, prompt_tokens bigint")
    assert Fm.evaluation_inputs(records, 20).count() == 2
    with pytest.raises(Exception, match="prompt of 2 is over 19"):
        Fm.evaluation_inputs(records, 19).collect()
    rows = spark.createDataFrame([(i, "ab"[i % 2], ("PRESENT", "ABSENT")[i // 2 % 2], f"g{i}") for i in range(160)], "query_id bigint, collection string, label string, group_id string")
    _, seed, tried = C.stratified_group_split(rows, 8, range(42, 45), {"train": 3, "validation": 1, "test": 2})
    assert {r.partition for r in tried.filter(F.col("seed") == seed).filter("passed").collect()} == {"train", "validation", "test"}
    assert {r.reason for r in Fm.cohort_file(spark.createDataFrame([("t", 1), ("t", 2)], "partition string, id bigint"), spark.createDataFrame([("t", 3, "overlength_sequence")], "partition string, id bigint, reason string"), 42).collect()} == {None, "overlength_sequence"}
