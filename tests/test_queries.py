"""Every registered query of the core against its SQL, on the small tables."""

import collections
import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

from skyloom.catalogue import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = collections.Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == collections.Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_shuffle_is_a_permutation_that_the_seed_decides(spark):
    a, b = ([r[0] for r in QUERIES["o3_shuffle_rows"](spark, DATA).collect()] for _ in range(2))
    assert a == b and a != sorted(a) and len(set(a)) == len(a)


def test_long_titles_keep_their_end(spark, tmp_path):
    spark.range(1).selectExpr("id AS page_id", "concat('<title>', repeat('x', 1000100), '</title>') AS html").write.parquet(f"{tmp_path}/pages.parquet")
    assert QUERIES["t5_extract_between"](spark, str(tmp_path)).selectExpr("length(title)").first()[0] == 1_000_100


#: Words that go on with a letter beyond ASCII, white space of several kinds, and plain cases beside them.
ODD_TEXTS = ["+1 (644) 555-4442 leç. En", "dans 4077922580886963 laéouèè", "12\v34 to 5", "3 \vto", "7 -\v9 to", "1,200 - 1,300.5\tto", "5\f\nthe 6 LE", "7 DeÉ 8\u2003to", "9 le_ 10 le9 11 le", "12to13to", "", None]


@pytest.fixture(scope="module")
def odd_texts(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('odd')}"
    spark.createDataFrame(list(enumerate(ODD_TEXTS)), "doc_id long, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    return path, con


def test_measurements_in_odd_texts_as_in_sql(spark, odd_texts):
    path, con = odd_texts
    name = "t2_measurements_in_documents"
    got = {tuple(r) for r in QUERIES[name](spark, path).select("doc_id", "label", "value").collect()}
    assert got == set(con.sql(f"SELECT doc_id, label, value FROM ({ORACLES[name]})").fetchall()) and len(got) >= 6


def test_units_in_odd_texts_as_in_sql(spark, odd_texts):
    path, con = odd_texts
    name = "t3_convert_units_in_documents"
    got = {tuple(r) for r in QUERIES[name](spark, path).select("doc_id", "text").collect()}
    assert got == set(con.sql(f"SELECT doc_id, text FROM ({ORACLES[name]})").fetchall()) and len(got) == len(ODD_TEXTS)
