import json

import pytest
from pyspark.sql import functions as F

from lumenweir.functions import reports as R

PLACE = {"start_line": 2, "end_line": 3, "function": None}


def report(**more):
    return json.dumps({"analysis": "Why.", "verdict": "PRESENT", "location": PLACE} | more)


CASES = [
    (report(), "PRESENT"),
    (report(verdict="ABSENT", location=None), "ABSENT"),
    (report(location=None), "INVALID"),
    (report(verdict="ABSENT"), "INVALID"),
    (report(analysis=""), "INVALID"),
    (report(analysis=" \n"), "INVALID"),
    (report(analysis="x" * 1200), "PRESENT"),
    (report(analysis="x" * 1201), "INVALID"),
    (report(analysis=3), "INVALID"),
    (report(verdict="present"), "INVALID"),
    (report(location=PLACE | {"start_line": "2"}), "INVALID"),
    (report(location=PLACE | {"start_line": 2.0}), "INVALID"),
    (report(location=PLACE | {"start_line": 0}), "INVALID"),
    (report(location=PLACE | {"start_line": 4}), "INVALID"),
    (report(location=PLACE | {"end_line": 11}), "INVALID"),
    (report(location=PLACE | {"end_line": 10, "function": "f"}), "PRESENT"),
    (report(location=PLACE | {"function": 1}), "INVALID"),
    (report(location=PLACE | {"more": 1}), "INVALID"),
    (report(location={"start_line": 2, "end_line": 3}), "INVALID"),
    (report(extra=1), "INVALID"),
    ('{"verdict":"ABSENT","analysis":"a","location":null}', "INVALID"),
    ('{"analysis":"a","analysis":"a","verdict":"ABSENT","location":null}', "INVALID"),
    ('{"analysis":"a","verdict":"ABSENT","location":null} x', "INVALID"),
    ("[]", "INVALID"),
    ("", "INVALID"),
    (None, "INVALID"),
]


def test_verdicts(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, raw string")
    got = {r.i: r.v for r in df.select("i", R.verdict_of(F.col("raw"), F.lit(10)).alias("v")).collect()}
    assert [got[i] for i in range(len(CASES))] == [w for _, w in CASES]


def test_canonical_order(spark):
    df = spark.createDataFrame([(report(analysis='é "q"\n'),)], "raw string")
    r = df.select(R.canonical_report(F.col("raw")).alias("a"), R.canonical_report(F.col("raw"), "verdict_first").alias("v")).collect()[0]
    assert r.a == '{"analysis":"é \\"q\\"\\n","verdict":"PRESENT","location":{"start_line":2,"end_line":3,"function":null}}'
    assert list(json.loads(r.v)) == ["verdict", "analysis", "location"]


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ({"status": "OK", "report": json.loads(report()), "reason_code": None}, "accepted"),
        ({"reason_code": None, "status": "OK", "report": json.loads(report(verdict="ABSENT", location=None))}, "disagreed"),
        ({"status": "OK", "report": None, "reason_code": None}, "invalid"),
        ({"status": "OK", "report": json.loads(report()), "reason_code": "INSUFFICIENT_CONTEXT"}, "invalid"),
        ({"status": "UNSUPPORTED", "report": None, "reason_code": "INSUFFICIENT_CONTEXT"}, "unsupported"),
        ({"status": "UNSUPPORTED", "report": None, "reason_code": None}, "invalid"),
        ({"status": "UNSUPPORTED", "report": None, "reason_code": "OTHER"}, "invalid"),
        ({"status": "OK", "report": json.loads(report()), "reason_code": None, "x": 1}, "invalid"),
    ],
)
def test_answers(spark, answer, want):
    df = spark.createDataFrame([(json.dumps(answer),)], "raw string")
    assert df.select(R.answer_status(F.col("raw"), F.lit(10), F.lit("PRESENT"), F.lit(5), 10).alias("s")).collect()[0].s == want


def test_labels_and_forced(spark):
    df = spark.createDataFrame([(" PRESENT\n",), ("present",), ("ABSENT.",), ("",)], "raw string")
    assert [tuple(r) for r in df.select(R.label_verdict(F.col("raw")), R.forced_verdict(F.col("raw"))).collect()] == [("PRESENT", "INVALID"), ("INVALID", "INVALID"), ("INVALID", "ABSENT"), ("INVALID", "INVALID")]
