"""The corpus queries against their SQL, on the small tables."""

import collections
import glob
import os

import duckdb
import pytest

from skyloom.llm.queries import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = collections.Counter(tuple(r[c] for c in cols) for r in df.collect())
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == collections.Counter(tuple(r[i] for i in at) for r in rel.fetchall())


def test_templates_decide_where_no_rule_does(spark):
    judged = QUERIES["op5_url_templates"](spark, DATA.replace("sf0.001", "sf0.1")).where("rule IS NULL")
    n = {r["verdict"]: r["count"] for r in judged.groupBy("verdict").count().collect()}
    assert n["block"] > 0 and n["allow"] > 0
