import glob
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lumenweir.plans import release as L
from lumenweir.sources.stages import OtherRun, Stages, content_digest


def test_content_digest(spark):
    a = spark.createDataFrame([(1, "x", None), (2, None, 0.5), (2, None, 0.5)], "a int, b string, `c.d` double")
    same = a.repartition(3).select("b", "`c.d`", "a")
    assert content_digest(a) == content_digest(same)
    others = [a.distinct(), a.limit(0), a.withColumn("a", F.col("a").cast("long")), a.withColumnRenamed("b", "e"), a.fillna("", ["b"]), a.unionByName(a)]
    assert len({content_digest(x) for x in [a, *others]}) == 7


def test_a_rerun_reads_and_another_run_is_refused(spark, tmp_path):
    at, rows = str(tmp_path / "run"), spark.range(10).toDF("i")
    calls = []

    def build():
        calls.append(1)
        return {"even": rows.filter("i % 2 = 0"), "none": rows.limit(0)}

    one = Stages(spark, at, {"k": 1, "l": [1, 2]}, {"rows": rows})
    assert {n: df.count() for n, df in one.stage("split", build).items()} == {"even": 5, "none": 0}
    two = Stages(spark, at, {"l": [1, 2], "k": 1}, {"rows": rows.repartition(3)})
    assert two.key == one.key and {n: df.count() for n, df in two.stage("split", build).items()} == {"even": 5, "none": 0}
    two.stage("more", lambda: {"odd": rows.filter("i % 2 = 1")})
    assert (one.built, two.reused, two.built, len(calls)) == (["split"], ["split"], ["more"], 1)
    for settings, inputs, name in (({"k": 2, "l": [1, 2]}, {"rows": rows}, "settings.k"), ({"k": 1}, {"rows": rows}, "settings.l"), ({"k": 1, "l": [1, 2]}, {"rows": rows.filter("i > 0")}, "inputs.rows"), ({"k": 1, "l": [1, 2]}, {}, "inputs.rows")):
        with pytest.raises(OtherRun, match=name.replace(".", r"\.")):
            Stages(spark, at, settings, inputs)


def test_a_stage_cut_short_is_built_anew_and_a_damaged_one_is_found(spark, tmp_path):
    at, rows = str(tmp_path / "run"), spark.range(4).toDF("i")
    stages = Stages(spark, at, {}, {})

    def broken():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        stages.stage("s", broken)
    assert not stages.done("s")
    assert stages.stage("s", lambda: {"rows": rows})["rows"].count() == 4
    part = glob.glob(f"{at}/s/v-*/rows/*.parquet")[0]
    rows.limit(1).coalesce(1).write.parquet(str(tmp_path / "other"))
    with open(part, "wb") as out, open(glob.glob(str(tmp_path / "other" / "*.parquet"))[0], "rb") as other:
        out.write(other.read())
    Path(part).with_name(f".{Path(part).name}.crc").unlink()  # the local file system's own check
    with pytest.raises(ValueError, match="changed"):
        Stages(spark, at, {}, {}).stage("s", broken)


def test_staged_release(spark, tmp_path):
    corpus = spark.createDataFrame([(i, "c", ("PRESENT", "ABSENT")[i % 2], "pool", f"pragma solidity ^0.8; contract C{i} {{ int x{i} = {i}; }}") for i in range(8)], "path bigint, collection string, label string, origin string, content string")
    at = str(tmp_path / "release")
    first = {n: sorted(map(str, df.collect())) for n, df in L.staged_release(spark, at, corpus).items()}
    again = {n: sorted(map(str, df.collect())) for n, df in L.staged_release(spark, at, corpus.repartition(2)).items()}
    assert first == again and set(first) == {"rows", "exclusions", "edges", "statistics"}
    with pytest.raises(OtherRun, match=r"settings\.seed"):
        L.staged_release(spark, at, corpus, L.ReleaseConfig(seed=43))
