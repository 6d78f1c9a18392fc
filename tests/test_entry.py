"""Every query of the library's own operators runs on the smallest tables and equals its SQL, where it has one."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from lumenweir.plans import catalogue

D = "/root/testdata/sf0.001"
#: A learner tested elsewhere, and a split whose gates the smallest tables can't pass.
ELSEWHERE = {"tfidf_logreg", "stratified_group_split"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{D}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def shown(v):
    return f"{v:.9g}" if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - ELSEWHERE))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, D)
    rows = df.collect()
    if name in catalogue.SQL:
        rel = con.sql(catalogue.SQL[name])
        cols = sorted(rel.columns)
        assert sorted(df.columns) == cols
        at = [rel.columns.index(c) for c in cols]
        assert sorted("|".join(shown(r[c]) for c in cols) for r in rows) == sorted("|".join(shown(r[i]) for i in at) for r in rel.fetchall())
    else:
        assert rows


def test_entry_and_registries(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_split_passes_its_gates(spark):
    got = catalogue.QUERIES["stratified_group_split"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 24 and sum(r.n for r in got) == spark.read.parquet("/root/testdata/sf0.01/labels.parquet").count()
