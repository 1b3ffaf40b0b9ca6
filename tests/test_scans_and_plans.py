"""Running values over slices, joins in a common order, and the plans of joins with large facts."""

import bisect
import os
import random

import pytest
from py4j.protocol import Py4JError
from pyspark.sql import functions as F

from skyloom.catalogue import QUERIES
from skyloom.operators import joins as J
from skyloom.operators import sky as K
from skyloom.operators.scans import asof_join, prefix_scan
from skyloom.sources.literal import fits, literal_table, small_side

DATA = "/root/testdata/sf0.1"


def test_running_values_equal_a_loop(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), i * 7919 % 2003, rng.choice([None, *range(-5, 6)])) for i in range(2_000)]
    df = spark.createDataFrame(rows, "g string, o int, v int").repartition(5)
    carries = {"total": ("sum", "v"), "n": ("count", "v"), "top": ("max", "v"), "low": ("min", "v"), "seen": ("last", "v")}
    for inclusive in (True, False):
        got = {(r["g"], r["o"]): tuple(r[c] for c in carries) for r in prefix_scan(df, ["g"], ["o"], carries, inclusive=inclusive, slices=7).collect()}
        assert len(got) == len(rows)
        for g in {r[0] for r in rows}:
            past = []
            for _, o, v in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
                past += [v] if inclusive else []
                known = [x for x in past if x is not None]
                assert got[g, o] == ((sum(known), len(known), max(known), min(known), known[-1]) if known else (None, 0, None, None, None))
                past += [] if inclusive else [v]


def test_one_group_is_many_tasks(spark):
    df = spark.range(1_000_000).select(F.lit("one").alias("g"), F.col("id"), (F.col("id") % 3).alias("v"))
    out = prefix_scan(df, ["g"], ["id"], {"total": ("sum", "v")}, slices=8)
    assert out.where("total <> div(id, 3) * 3 + CASE id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 3 END").isEmpty()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 2 and max(sizes) < 600_000


def test_no_rows_and_one_row(spark):
    df = spark.createDataFrame([], "g string, o int, v int")
    assert prefix_scan(df, ["g"], ["o"], {"t": ("sum", "v")}).collect() == []
    assert prefix_scan(spark.createDataFrame([(None, None, 3)], df.schema), ["g"], ["o"], {"t": ("last", "v")}).first()["t"] == 3


@pytest.mark.parametrize("strict", [True, False])
def test_asof_join_finds_the_last_mark(spark, strict):
    rng = random.Random(2)
    marks = {k: sorted(rng.sample(range(300), 60)) for k in ("x", "y")}
    rows = [(i, rng.choice(["x", "y", "z"]), rng.randrange(-10, 310)) for i in range(1_500)]
    got = asof_join(spark.createDataFrame(rows, "id int, k string, at int"), spark.createDataFrame([(k, m, f"{k}{m}") for k, v in marks.items() for m in v], "k string, m int, name string"), "at", "m", ("k",), strict=strict, slices=6)
    found = {r["id"]: r["m"] for r in got.collect()}
    assert len(found) == len(rows)
    for i, k, at in rows:
        own = marks.get(k, [])
        n = (bisect.bisect_left if strict else bisect.bisect_right)(own, at)
        assert found[i] == (own[n - 1] if n else None)


def test_brackets_are_the_same_in_order_and_by_comparison(spark):
    rng = random.Random(3)
    pal = spark.createDataFrame([(a, f"c{a}") for a in rng.sample(range(-500, 500), 200)], "alt int, c string")
    obs = spark.createDataFrame([(i, rng.choice([rng.uniform(-600, 600), float(rng.randrange(-500, 500))])) for i in range(2_000)], "id int, sa double")
    both = [{r["id"]: (r["alt"], r["c"], r["next_alt"], r["next_c"], r["t"]) for r in J.bracket_join(obs, pal, "sa", few=few).collect()} for few in (0, 1_000)]
    assert both[0] == both[1] and len(both[0]) == 2_000
    assert J.bracket_join(obs, pal.limit(1), "sa", few=0).collect() == [] == J.bracket_join(obs, pal.limit(0), "sa").collect()


def test_grid_of_large_dimensions(spark, monkeypatch):
    monkeypatch.setattr("skyloom.operators.joins.fits", lambda df, *a: False)
    a, b = spark.range(30).toDF("a"), spark.range(20).toDF("b")
    got = J.observation_grid(a, b)
    assert {tuple(r) for r in got.collect()} == {(i, j) for i in range(30) for j in range(20)} and got.count() == 600
    assert "Cartesian" not in plan_of(got) and "NestedLoop" not in plan_of(got)


def test_windows_over_the_years_end(spark):
    t = spark.createDataFrame([("2024-12-31",), ("2025-01-12",), ("2025-01-13",), ("2024-02-29",), ("2025-07-04",)], "d string").select(F.to_date("d").alias("d"))
    w = literal_table(spark, [("q", 1228, 112), ("leap", 229, 229), ("all", 101, 1231), ("none", 230, 230)], "name string, md_start int, md_end int")
    got = sorted((r["name"], str(r["d"])) for r in J.calendar_window_join(t, w, "d").collect())
    assert got == sorted([("q", "2024-12-31"), ("q", "2025-01-12"), ("leap", "2024-02-29"), *(("all", x) for x in ("2024-12-31", "2025-01-12", "2025-01-13", "2024-02-29", "2025-07-04"))])


def test_small_sides(spark):
    lit = literal_table(spark, [("it's \\d", 1.5, None), (None, 1e-7, True)], "s string, x double, b boolean")
    assert [tuple(r) for r in lit.collect()] == [("it's \\d", 1.5, None), (None, 1e-7, True)]
    assert fits(lit) and not fits(lit, 1) and not fits(spark.range(11), 10) and not fits(spark.range(2).select(F.repeat(F.lit("x"), 100)), 10, 50)
    assert "ResolvedHint" not in str(small_side(spark.range(200_000))._jdf.queryExecution().analyzed())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def large_facts(spark):
    """No table is small enough for Spark to broadcast by itself."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["j6_bracket_join", "j8_calendar_windows", "j9_observation_grid", "e2_heliocentric", "e7_observing_report", "e11_sky_gradient"])
def test_no_product_of_large_tables(spark, large_facts, name):
    plan = plan_of(QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in plan and "BuildLeft" not in plan
    assert name != "j8_calendar_windows" or "NestedLoop" not in plan


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["j2_lookup", "j3_allowlist", "p9_admit_requests", "p10_resolve_ttl", "j12_licence_gate", "j6_bracket_join"])
def test_facts_stay_where_they_are(spark, large_facts, name):
    plan = plan_of(QUERIES[name](spark, DATA))
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "CartesianProduct" not in plan
    assert "hashpartitioning(host" not in plan and "hashpartitioning(p_brand" not in plan and "hashpartitioning(source" not in plan


def test_elements_are_a_table_of_known_size(spark):
    assert K.elements_table(spark).count() == len(K.ELEMENTS)


def test_fan_out_is_the_join_by_place(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 7)
    monkeypatch.setattr(J, "CELL_ALERTS", 50)
    monkeypatch.setattr(J, "TASK_ROWS", 1_000)
    rng = random.Random(3)
    spot = lambda: (rng.choice([None, 1, 1, 1, 1, 2, 3]), rng.choice(["n", "n", "n", "s"]))
    alerts = spark.createDataFrame([(*spot(), rng.choice([None, *range(90)])) for _ in range(400)] + [(9, "n", 1)], "lat int, lon string, alert int")
    subs = spark.createDataFrame([(*spot(), rng.choice([None, "a", "a", "a", "b", str(i)])) for i in range(900)] + [(8, "n", "a")], "lat int, lon string, sub string")
    place = ["lat", "lon"]
    out, whole = J.fan_out(alerts, subs, place), alerts.join(subs, place)
    assert out.schema.names == whole.schema.names
    assert out.exceptAll(whole).isEmpty() and whole.exceptAll(out).isEmpty()
    assert J.fan_out(alerts, subs.where("lat = 8"), place).isEmpty()


def test_fan_out_of_one_hot_place(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(J, "TASK_ROWS", 1 << 17)
    alerts = spark.range(1_500).select(F.xxhash64("id").alias("alert"), F.lit(1).alias("place"))
    subs = spark.range(2_000).select(F.xxhash64(F.col("id") + 5_000).alias("sub"), F.lit(1).alias("place"))
    out = J.fan_out(alerts, subs, ["place"]).select("alert", "sub")
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 3_000_000 and max(sizes) < 2_000_000
    out.write.parquet(f"{tmp_path}/out")
    assert sum(f.stat().st_size for f in tmp_path.glob("out/*.parquet")) < 1_000_000


def test_fan_out_is_sent_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 63)
    alerts = spark.range(0, 2_000, 1, 1).select(F.col("id").alias("alert"), F.lit(1).alias("place"))  # one partition
    subs = spark.range(630).select(F.col("id").alias("sub"), F.lit(1).alias("place"))
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark.sparkContext._jsc.sc().statusStore()
    first = spark.sparkContext._jsc.sc().dagScheduler().nextStageId()
    assert J.fan_out(alerts, subs, ["place"]).count() == 1_260_000
    bus.waitUntilEmpty(30_000)
    sent = []
    for stage in range(first, spark.sparkContext._jsc.sc().dagScheduler().nextStageId()):
        try:
            tasks = store.taskList(stage, 0, 1_000)
        except Py4JError:  # a stage that was skipped
            continue
        sent += [tasks.apply(i).taskMetrics().get().shuffleWriteMetrics().recordsWritten() for i in range(tasks.size())]
    assert sum(sent) > 20_000 and max(sent) < 10_000


def test_fan_out_of_maps(spark):
    alerts = spark.range(40).select((F.col("id") % 3).alias("place"), F.create_map(F.lit("id"), "id").alias("alert"))
    subs = spark.range(70).select((F.col("id") % 4).alias("place"), F.create_map(F.lit("key"), "id").alias("sub"))
    got = sorted((r["place"], r["alert"]["id"], r["sub"]["key"]) for r in J.fan_out(alerts, subs, ["place"]).collect())
    assert got == sorted((a % 3, a, s) for a in range(40) for s in range(70) if a % 3 == s % 4)
