"""Edge cases on tiny tables."""

import collections
import datetime
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import text as T
from skyloom.operators import aggregates as A
from skyloom.operators import colour, feeds, scans
from skyloom.operators import joins as J
from skyloom.operators import predicates as P
from skyloom.operators import sky as K
from skyloom.operators.components import link_components


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_object_classes_follow_rule_order(spark):
    df = spark.createDataFrame([("GlC",), ("Cl*",), ("GNe",), ("SNR",), (None,), ("",), ("PN",)], "t string")
    got = [r[0] for r in df.select(T.classify_first_match(F.col("t"), T.OBJECT_CLASS, "neb", lower=False)).collect()]
    assert got == ["glob", "open", "gal", "neb", "neb", "neb", "pneb"]


def test_tolerant_numbers(spark):
    df = spark.createDataFrame([("1.5",), ("0",), ("",), ("abc",), (None,), ("NaN",)], "v string")
    assert [r[0] for r in df.select(P.tolerant_number("v", 0.5)).collect()] == [1.5, 0.0, 0.5, 0.5, 0.5, 0.5]
    assert [r[0] for r in df.select(P.tolerant_number("v")).collect()][2:] == [None] * 4


def test_depth_ramp_edges(spark):
    df = spark.createDataFrame([(10.0, 6.0), (10.0, 6.1), (-85.0, 7.5), (-85.1, 1.0), (-37.5, 6.75)], "beta double, mag double")
    assert P.filter_depth_ramp(df).count() == 3


def test_prefixed_ids(spark):
    df = spark.createDataFrame([("M 31",), ("M31",), ("M x",), ("NGC 1",), (None,)], "id string")
    assert [r[0] for r in df.select(P.parse_prefixed_id("id", "M ")).collect()] == [31, None, None, None, None]


def test_window_over_the_years_end(spark):
    w = spark.createDataFrame([("q", 1228, 112), ("d", 704, 704)], "name string, md_start int, md_end int")
    t = spark.createDataFrame([(datetime.datetime(2024, *md),) for md in ((12, 28), (1, 12), (1, 13), (7, 4), (12, 27))], "ts timestamp_ntz")
    assert sorted(r["name"] for r in J.calendar_window_join(t, w, "ts").collect()) == ["d", "q", "q"]


def test_brackets_clamp_and_close(spark):
    pal = spark.createDataFrame([(-18,), (0,), (60,)], "alt int")
    obs = spark.createDataFrame([(-99.0,), (-18.0,), (0.0,), (30.0,), (60.0,), (99.0,)], "sa double")
    got = {r["sa"]: (r["alt"], r["t"]) for r in J.bracket_join(obs, pal, "sa").collect()}
    assert got == {-99.0: (-18, 0.0), -18.0: (-18, 0.0), 0.0: (-18, 1.0), 30.0: (0, 0.5), 60.0: (0, 1.0), 99.0: (0, 1.0)}


def test_proximity_has_a_today(spark):
    df = spark.createDataFrame([(0,), (5,), (-3,), (180,), (-31,)], "d int")
    assert [r[0] for r in df.select(J.event_proximity(F.col("d"))).collect()] == ["today", "in 5 days", "recently", None, None]


@pytest.mark.parametrize("n, cap", [(10, 4), (400, 399), (7, 7), (3, 5), (1000, 37)])
def test_sample_takes_the_floors(spark, n, cap):
    df = spark.range(n).select(F.lit("g").alias("g"), "id")
    caps = spark.createDataFrame([("g", cap)], "g string, cap int")
    got = sorted(r["id"] for r in A.systematic_sample(df, "g", "id", caps).collect())
    assert got == (sorted(int(i * (n / cap)) for i in range(cap)) if n > cap else list(range(n)))


def test_components_do_not_join_diagonally_and_ties_go_to_the_first(spark):
    cells = spark.createDataFrame([("i", 0, 0, 20), ("i", 1, 0, 20), ("i", 2, 1, 20), ("i", 2, 2, 20), ("i", 5, 5, 18)], "image_id string, x int, y int, lum int")
    boxes = A.component_bbox(A.components_of_cells(cells, 18, link_components))
    assert sorted((r["area"], r["min_x"], r["min_y"]) for r in boxes.collect()) == [(2, 0, 0), (2, 2, 1)]
    assert A.pick_largest(boxes, "image_id", [F.desc("area"), "seed"]).first()["min_x"] == 0


def test_images_of_like_names_stay_apart(spark):
    """These two names agree in the low 22 bits of their hash."""
    cells = [(i, x, 0, 20) for i, at in (("img12788", (0, 1)), ("img8001", (1, 2)), (None, (2, 3))) for x in at]
    boxes = A.component_bbox(A.components_of_cells(spark.createDataFrame(cells, "image_id string, x int, y int, lum int"), 18, link_components))
    assert {(r["image_id"], r["area"], r["min_x"], r["max_x"]) for r in boxes.collect()} >= {("img12788", 2, 0, 1), ("img8001", 2, 1, 2)}


def test_long_chain_is_one_component(spark):
    links = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in link_components(links).collect()} == {0}


def test_gate(spark):
    with pytest.raises(ValueError):
        A.require_rows(spark.range(5), 6)
    assert A.require_rows(spark.range(5), 5).count() == 5


def test_anchors(spark):
    df = spark.createDataFrame([("a<b>x</b>y",), ("no",), ("<b>open",), (None,)], "s string")
    good, bad = T.extract_between(df, "s", "<b>", "</b>")
    assert [r["cut"] for r in good.collect()] == ["<b>x"] and bad.count() == 3
    assert [r["rest"] for r in T.drop_between(df, "s", "<b>", "</b>")[0].collect()] == ["ay"]


def test_units(spark):
    df = spark.createDataFrame([("1,200 km and 5.5KM, 3 kmh",), ("none",), (None,)], "s string")
    assert [r[0] for r in df.select(T.convert_units_in_text("s")).collect()] == ["746 mi and 3 mi, 3 kmh", "none", None]


def test_half_rounds_up_below_zero(spark):
    assert spark.range(1).select(P.js_round(F.lit(-2.5))).first()[0] == -2


def test_ephemeris_anchors(spark):
    ts = [datetime.datetime(2000, 1, 1, 12), datetime.datetime(2000, 3, 20, 7, 35), datetime.datetime(2000, 1, 21, 4, 40), datetime.datetime(2024, 4, 8, 18, 21)]
    inst = K.with_julian_day(spark.createDataFrame([(t,) for t in ts], "ts timestamp"), "ts")
    got = {r["ts"]: r for r in K.moon_phase_calendar(inst).collect()}
    assert got[ts[0]]["jd"] == 2451545.0
    assert min(got[ts[1]]["sun_lon"], 360 - got[ts[1]]["sun_lon"]) < 0.05  # equinox
    assert abs(got[ts[2]]["angle"] - 180) < 1  # full Moon
    assert min(got[ts[3]]["angle"], 360 - got[ts[3]]["angle"]) < 1  # new Moon, an eclipse
    assert all(350_000 < r["moon_km"] < 410_000 and 0 <= r["illum"] <= 100 for r in got.values())


def test_horizon_ranges(spark):
    inst = K.with_julian_day(spark.createDataFrame([(datetime.datetime(2024, 6, 1, h),) for h in range(0, 24, 6)], "ts timestamp"), "ts")
    obs = spark.createDataFrame([(1, 90.0, 0.0), (2, -33.0, 151.0), (3, 0.0, 180.0)], "obs_id int, lat double, lon double")
    out = K.observing_report(K.apparent_positions(K.elements_table(spark), inst), obs).collect()
    assert len(out) == 4 * 7 * 3
    assert all(-90 <= r["alt"] <= 90 and 0 <= r["az"] <= 360 and 0 <= r["elongation"] <= 180 for r in out)
    pole = [r for r in out if r["obs_id"] == 1]
    assert all(abs(r["alt"] - math.degrees(r["dec"])) < 1e-6 for r in pole)


def test_galactic_plane_has_the_known_centre(spark):
    g = K.galactic_grid(spark, 4, 0.0).where("gal_lon = 0").first()
    assert abs(g["ra"] - 266.4) < 0.1 and abs(g["dec"] + 28.94) < 0.1


def test_gradient_without_weather_is_the_palette(spark):
    pal = spark.createDataFrame([(0, "#000000", "#000000", "#000000", "#000000"), (10, "#102030", "#102030", "#102030", "#102030")], "alt int, c0 string, c1 string, c2 string, c3 string")
    obs = spark.createDataFrame([(0, 40.0), (1, -40.0)], "id int, sun_alt double")
    for c, t in (("evening", "boolean"), *((c, "double") for c in ("cl", "cm", "ch", "rh", "vis_m", "pr", "sn"))):
        obs = obs.withColumn(c, F.lit(None).cast(t))
    got = {r["id"]: r["sky0"] for r in colour.sky_gradient(obs, pal).collect()}
    assert got == {0: "#102030", 1: "#000000"}


def test_replay_states(spark):
    data = [(1, 0.0, True), (2, 5.0, True), (3, 20.0, False), (4, 25.0, True), (5, 26.0, False)]
    df = spark.createDataFrame([("u", i, t, 10.0, ok) for i, t, ok in data] + [("v", 9, 0.0, 10.0, False)], "k string, id int, t double, ttl double, ok boolean")
    got = {r["id"]: (r["state"], r["age"]) for r in feeds.replay_cache(df, "k", ["t", "id"], "t", "ttl", "ok").collect()}
    assert got == {1: ("MISS", 0.0), 2: ("HIT", 5.0), 3: ("STALE-ERR", None), 4: ("REVALIDATED", 0.0), 5: ("HIT", 1.0), 9: ("MISS-ERR", None)}


def test_replay_of_a_long_history(spark):
    n = 100_000
    df = spark.range(n).select(F.lit(1).alias("k"), "id", F.col("id").cast("double").alias("t"), F.lit(10.0).alias("ttl"), F.lit(True).alias("ok"))
    out = feeds.replay_cache(df, "k", ["t", "id"], "t", "ttl", "ok")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan  # no history in one row
    got = {r[0]: r[1] for r in out.groupBy("state").count().collect()}
    assert got == {"MISS": 1, "REVALIDATED": n // 10 - 1, "HIT": n - n // 10}


def test_stream_replays_as_batch(spark, tmp_path):
    from skyloom.streaming.feeds import replay_cache_stream

    df = spark.range(200).select(
        (F.col("id") % 7).alias("key"), "id", F.col("id").cast("double").alias("t"), F.lit(20.0).alias("ttl"), (F.col("id") % 3 > 0).alias("ok")
    )
    df.where("id < 100").coalesce(1).write.parquet(f"{tmp_path}/in/a")
    df.where("id >= 100").coalesce(1).write.parquet(f"{tmp_path}/in/b")
    s = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = replay_cache_stream(s).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["id"]: (r["state"], r["age"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {r["id"]: (r["state"], r["age"]) for r in feeds.replay_cache(df, "key", ["t", "id"], "t", "ttl", "ok").collect()}
    assert got == want


def test_a_replayed_batch_delivers_nothing_twice(spark, tmp_path):
    from skyloom.streaming.feeds import write_unsent

    inbox, fail = [], [True]

    def deliver(rows, batch_id):
        if fail.pop() if fail else False:
            raise OSError("sink is away")
        inbox.extend((batch_id, r["k"]) for r in rows.collect())

    batches = {0: [1, 2, 2], 1: [2, 3], 2: [1, 4]}
    frame = lambda b: spark.createDataFrame([(k, "x") for k in batches[b]], "k long, v string")
    with pytest.raises(OSError):
        write_unsent(frame(0), 0, f"{tmp_path}/sent", ["k"], deliver)
    for b in (0, 0, 1, 1, 2, 1, 2):
        write_unsent(frame(b), b, f"{tmp_path}/sent", ["k"], deliver)
    assert sorted(inbox) == [(0, 1), (0, 2), (1, 3), (2, 4)]


def test_nulls_form_groups_of_a_sample(spark):
    df = spark.range(50).select(F.when(F.col("id") < 20, "g").alias("g"), "id")
    got = A.systematic_sample(df, "g", "id", spark.createDataFrame([("g", 4)], "g string, cap int")).collect()
    assert sorted(r["id"] for r in got if r["g"]) == [0, 5, 10, 15] and sum(r["g"] is None for r in got) == 30


def test_rule_sets_of_a_table(spark):
    df = spark.createDataFrame([("Big Ice", "x"), ("rock", "y"), (None, "z"), ("Big Ice", "x")], "a string, b string")
    rules = spark.createDataFrame([("s", 2, "ice|rock", "two"), ("s", 1, "big", "one"), ("t", 1, "y", "why")], "rule_set string, priority int, pattern string, label string")
    got = [(r["s"], r["t"]) for r in T.classify_by_table(df, {"s": "a", "t": "b"}, rules, {"s": "none"}).collect()]
    assert got == [("one", None), ("two", "why"), ("none", None), ("one", None)]
    with pytest.raises(ValueError):
        T.classify_by_table(df, {"s": "a"}, rules, {}, most=2)


def test_nearest_events_across_cells(spark):
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    now = spark.createDataFrame([(i, 1, day(100 + i)) for i in range(60)], "id int, k int, now timestamp")
    ev = spark.createDataFrame([(1, day(n)) for n in (75, 300)], "k int, ev timestamp")
    got = {r["id"]: r["days"] for r in J.event_proximity_join(now, ev, "k", "now", "ev").collect()}
    want = {}
    for i in range(60):
        near = [n - 100 - i for n in (75, 300) if -30 <= n - 100 - i < 180]
        if near:
            want[i] = min(near, key=lambda x: (abs(x), -x))
    assert got == want


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    from skyloom.sources import shared

    class Away:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})  # noqa: N815

    with pytest.raises(RuntimeError):
        shared.shared_folder(Away())
    t = shared.saved(spark.range(3))
    assert t.count() == 3
    shared.discard(t)
    assert not os.path.exists(t._saved_at.removeprefix("file://"))


def test_quiet_hours_over_midnight(spark):
    df = spark.createDataFrame([(23,), (6,), (7,), (12,)], "h int")
    assert [r[0] for r in df.select(feeds.in_quiet_hours(F.col("h"), F.lit(22), F.lit(7))).collect()] == [True, True, False, False]
    assert not df.select(feeds.in_quiet_hours(F.col("h"), F.lit(7), F.lit(7)).alias("q")).where("q").count()


def test_gradient_computed_by_hand(spark):
    """At a breakpoint of the palette: a clear day leaves its colours; snow of 1 blends by 0.5 towards its four targets."""
    from skyloom.operators.colour import sky_gradient
    from skyloom.plans.sky import PAL_SCHEMA, PALETTE

    obs = "id int, sun_alt double, evening boolean, cl double, cm double, ch double, rh double, vis_m double, pr double, sn double"
    rows = [(1, 10.0, False, *[None] * 7), (2, 10.0, None, 0.0, 0.0, 0.0, 50.0, 30000.0, 0.0, 1.0)]
    got = {r["id"]: (r["sky0"], r["sky1"], r["sky2"], r["sky3"]) for r in sky_gradient(spark.createDataFrame(rows, obs), spark.createDataFrame(PALETTE, PAL_SCHEMA)).collect()}
    assert got == {1: ("#2f6cc0", "#5a92d6", "#93bce6", "#d4e2ee"), 2: ("#446a9c", "#6285af", "#87a2bf", "#aeb9c7")}


@pytest.mark.parametrize("side", [4, 7, 256])
def test_components_over_tile_borders(spark, side):
    """Random cells of two images, with repeated rows and negative places, against a flood fill; rounds follow tiles."""
    rng = random.Random(side)
    cells = [(img, x, y, 20 if rng.random() < 0.58 else 10) for img in ("a", "b") for x in range(-5, 30) for y in range(-3, 22)]
    cells += cells[:50] + [("a", None, 3, 99)]
    on = {c[:3] for c in cells if c[3] > 18 and c[1] is not None}
    want, seen = collections.Counter(), set()
    for cell in on:
        if cell in seen:
            continue
        group, todo = set(), [cell]
        while todo:
            c = todo.pop()
            if c in on and c not in group:
                group.add(c)
                todo += [(c[0], c[1] + dx, c[2] + dy) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))]
        seen |= group
        want[frozenset(group)] += 1
    rounds = []
    got = A.components_of_cells(spark.createDataFrame(cells, "image_id string, x int, y int, lum int").repartition(3), 18, lambda p: rounds.append(p.count()) or link_components(p), side).collect()
    found = collections.defaultdict(set)
    for r in got:
        found[r["image_id"], r["comp"]].add((r["image_id"], r["x"], r["y"]))
    assert collections.Counter(frozenset(v) for v in found.values()) == want
    assert len(got) == sum(c[3] > 18 and c[1] is not None for c in cells)
    assert side < 256 or rounds == [] or rounds[0] < 60


def test_a_snake_is_one_component_of_its_tile():
    from skyloom.operators.components import grid_labels

    side = 64
    snake = [(x, y) for y in range(side) for x in range(side) if y % 2 == 0 or x == (side - 1 if y % 4 == 1 else 0)]
    x, y = (np.array(v) for v in zip(*snake, strict=True))
    assert set(grid_labels(np.zeros(len(x), int), x, y, side)) == {0}


REQUEST = "k string, id int, t double, ttl double, ok boolean, threw boolean, state0 int"


@pytest.mark.parametrize("seed", [1, 2])
def test_pointers_replay_as_the_fold_does(spark, seed):
    """One hot key and a null one: ttls that vary, some null, zero or below; times that tie or are missing."""
    rng = random.Random(seed)
    rows, t = [], 0.0
    for i in range(600):
        t += rng.choice([0, 1, 1, 2, 5, 30])
        time = None if i % 97 == 0 else t
        rows.append((rng.choice(["hot", "hot", "hot", None, "few"]), i, time, rng.choice([10.0] * 8 + [3.0, 50.0, None, 0.0, -1.0]), rng.random() < 0.7 or (None if rng.random() < 0.2 else False), rng.choice([True, False, None]), 0))
    df = spark.createDataFrame(rows, REQUEST)
    run = lambda n: {r["id"]: (r["state"], r["age"]) for r in feeds.replay_cache(df, "k", ["t", "id"], "t", "ttl", "ok", F.col("threw"), hot_rows=n).collect()}
    want = run(1_000)
    assert run(50) == want and run(0) == want and len(want) == 600
    assert {s for s, _ in want.values()} == {"HIT", "MISS", "REVALIDATED", "STALE-ERR", "MISS-ERR", None}


def test_one_hot_url_is_many_tasks(spark):
    df = spark.range(200_000).select(F.lit("one").alias("k"), F.col("id"), (F.col("id") * 7 % 13 + F.col("id") * 10).cast("double").alias("t"), F.lit(300.0).alias("ttl"), (F.col("id") % 11 != 0).alias("ok"))
    out = feeds.replay_cache(df, "k", ["t", "id"], "t", "ttl", "ok", hot_rows=1_000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 2 and max(sizes) < 150_000
    whole = feeds.replay_cache(df, "k", ["t", "id"], "t", "ttl", "ok")
    assert out.exceptAll(whole).isEmpty() and out.count() == 200_000


def test_pointers_are_not_sent_through_the_driver(spark, monkeypatch):
    plans = []

    def noted(df, name="table", saved=feeds.saved, **options):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return saved(df, name, **options)

    monkeypatch.setattr(feeds, "saved", noted)
    monkeypatch.setattr(scans, "saved", noted)
    df = spark.range(2_000).select((F.col("id") % 3).alias("k"), "id", F.col("id").cast("double").alias("t"), F.lit(10.0).alias("ttl"), F.lit(True).alias("ok"))
    assert feeds.replay_cache(df, "k", ["t", "id"], "t", "ttl", "ok", hot_rows=0).count() == 2_000
    joins = [p for name, p in plans if "Join" in p]
    assert {"reached", "jumps", "slices"} <= {name for name, p in plans if "Join" in p}
    assert not [p for p in joins if "Broadcast" in p]


def test_a_generation_appears_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    from skyloom.sources import landed as S

    path = f"file://{tmp_path}/snap"
    a, b = spark.range(10).toDF("a"), spark.range(4).toDF("b")
    with pytest.raises(ValueError, match="nothing is published"):
        S.read_snapshot(spark, path, "a")
    assert S.write_snapshot({"a": a, "b": b}, path, "1", least={"a": 10}) == {"a": 10, "b": 4}
    counts = lambda: (S.read_snapshot(spark, path, "a").count(), S.read_snapshot(spark, path, "b").count())
    held = S.read_snapshot(spark, path, "a")
    with pytest.raises(ValueError, match="b has 4 rows; 5 are needed"):
        S.write_snapshot({"a": a.union(a), "b": b}, path, "2", least={"b": 5})
    with pytest.raises(Exception, match="(?i)zero"):
        S.write_snapshot({"a": a.union(a), "b": b.selectExpr("1 / (b - 2) AS b")}, path, "2")
    assert counts() == (10, 4) and len(list(tmp_path.glob("snap/generations/*"))) == 1
    put = S.put_text

    def killed(spark, where, text):
        if where.endswith(S.CURRENT):
            raise KeyboardInterrupt
        put(spark, where, text)

    monkeypatch.setattr(S, "put_text", killed)
    with pytest.raises(KeyboardInterrupt):
        S.write_snapshot({"a": a.union(a), "b": b.union(b)}, path, "2")
    assert counts() == (10, 4)
    monkeypatch.setattr(S, "put_text", put)
    S.write_snapshot({"a": a.union(a), "b": b.union(b)}, path, "2")
    assert counts() == (20, 8) and held.count() == 10


def test_the_gate_runs_the_plan_once(spark):
    ran = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            ran.add(batch.num_rows)
            yield batch

    assert A.require_rows(spark.range(50).mapInArrow(count, "id long"), 50).count() == 50
    assert ran.value == 50


CHANGE = "endpoint long, n long, change string"


def test_upserts_touch_few_buckets_and_replay(spark, tmp_path):
    from skyloom.streaming import upserts as U

    path = f"file://{tmp_path}/table"
    rng, want = random.Random(6), {}
    batches = [[(rng.randrange(40), rng.randrange(1_000), rng.choice(["subscribe", "unsubscribe", "gone"])) for _ in range(30)] for _ in range(5)] + [[], [(7, 2_000, "subscribe")]]
    put = U.put_text
    for n, rows in enumerate(batches):
        df = spark.createDataFrame(rows, CHANGE)
        U.put_text = lambda *a: (_ for _ in ()).throw(KeyboardInterrupt)  # killed before it is in
        before = {r["endpoint"]: r["n"] for r in U.upserted(spark, path, df.schema).collect()}
        with pytest.raises(KeyboardInterrupt):
            U.upsert_batch(df, n, path, ["endpoint"], ["n", "change"], 8)
        U.put_text = put
        assert {r["endpoint"]: r["n"] for r in U.upserted(spark, path, df.schema).collect()} == before
        for _ in range(2):  # the second time it is a replay
            U.upsert_batch(df, n, path, ["endpoint"], ["n", "change"], 8)
        for e, k, c in rows:
            want[e] = max(want.get(e, (-1, "")), (k, c))
        got = [tuple(r) for r in U.upserted(spark, path, df.schema).collect()]
        assert len(got) == len(want) and {e: (k, c) for e, k, c in got} == want
    state = U.state_of(spark, path)
    assert state["batch"] == 6 and sum(own == "batch=6" for own in state["buckets"].values()) == 1  # the last batch wrote one bucket
    folders = {f"{p.parent.name}/{p.name}" for p in tmp_path.glob("table/batch=*/bucket=*")}
    assert folders == {f"{own}/bucket={b}" for b, own in state["buckets"].items()} | set(state["stale"])


def test_deliveries_end_subscriptions(spark):
    from skyloom.streaming.upserts import latest, subscription_changes

    log = [(1, 1, "subscribe", None), (1, 2, None, 410), (2, 1, "subscribe", None), (2, 2, None, 201), (3, 1, "subscribe", None), (3, 2, None, 404), (3, 3, "subscribe", None)]
    df = spark.createDataFrame(log, "e long, n long, action string, status int")
    now = latest(subscription_changes(df, "e", F.col("action"), F.col("status")), ["endpoint"], ["n"])
    assert {r["endpoint"] for r in now.where("change = 'subscribe'").collect()} == {2, 3}


def test_forgotten_values_leave_no_state(spark, tmp_path):
    """Five batches; keys that fall silent are gone from the state once the watermark has passed their day."""
    from skyloom.streaming.feeds import last_good_value_stream, poll_feed_stream

    schema = "key long, id long, ts timestamp, value double, ok boolean"
    rows = [(k, 10 * b + k, datetime.datetime(2024, 1, 1 + b), float(b), True) for b in range(5) for k in range(4) if k == 3 or b == k]
    for b in range(5):
        spark.createDataFrame([r for r in rows if r[1] // 10 == b], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = last_good_value_stream(poll_feed_stream(spark, f"{tmp_path}/in", schema, "*.parquet", files_per_batch=1), 86_400, "1 hour")
    q = s.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert len([p for p in q.recentProgress if p["numInputRows"]]) == 5
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(rows)
    left = spark.read.format("statestore").option("stateVarName", "good").load(f"{tmp_path}/c").selectExpr("key.key AS key").collect()
    assert [r["key"] for r in left] == [3]


def test_lines_are_read_without_going_back_to_the_file(spark, tmp_path):
    from skyloom.sources import landed as S

    one = '{"id":"a","geometry":{"type":"LineString","coordinates":[[1,2],[3.5,4]]}}'
    many = '{"id":"é","geometry":{"type":"MultiLineString","coordinates":[[[5,6]],[],[[7,8],[9,10]]]}}'
    (tmp_path / "a.json").write_text(f'{{"type":"FeatureCollection",\n "features":[{one},\n{many}]}}')
    (tmp_path / "b.json").write_text("no json")
    got = S.scan_geojson_lines(spark, str(tmp_path))
    assert "Format: JSON" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(rows(got)) == [("a", 0, 0, 1.0, 2.0), ("a", 0, 1, 3.5, 4.0), ("é", 0, 0, 5.0, 6.0), ("é", 2, 0, 7.0, 8.0), ("é", 2, 1, 9.0, 10.0)]


def test_nested_lines_are_dealt_once(spark):
    df = spark.range(20).selectExpr("id % 3 AS id", "id % 2 AS seg", "id AS pos", "id * 2 AS x")
    out = A.collect_ordered_nested(df, "id", "seg", "pos", ["x"])
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {r["id"]: r["lines"] for r in out.collect()}[0] == [[[0], [12], [24], [36]], [[6], [18], [30]]]


def test_a_key_has_one_timer_and_its_rows_go_by_their_time():
    from pyspark.sql import Row

    from skyloom.streaming.feeds import LastGood

    class Handle:
        def __init__(self):
            self.state, self.timers = None, []

        def getValueState(self, name, schema):  # noqa: N802
            return self

        def registerTimer(self, at):  # noqa: N802
            self.timers.append(at)

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.mark

        def get(self):
            return self.state

        def update(self, new):
            self.state = new

        def clear(self):
            self.state = None

    h, p = Handle(), LastGood(10_000)  # microseconds
    p.init(h)
    batch = lambda *rows: [(r["id"], r["served"]) for r in p.handleInputRows((1,), iter([Row(id=i, at=at, value=v, ok=ok) for i, at, v, ok in rows]), h)]
    assert batch((1, 1_002, 2.0, True), (2, 1_001, 1.0, True)) == [(2, 1.0), (1, 2.0)]  # within one millisecond
    assert batch((3, 5_000, None, True), (4, 6_000, 3.0, False), (5, 9_000, 4.0, True)) == [(3, 2.0), (4, 2.0), (5, 4.0)]
    assert h.timers == [12]
    h.mark = 12
    assert list(p.handleExpiredTimer((1,), h, None)) == [] and h.state == (4.0, 9_000) and h.timers == [12, 20]
    h.mark = 20
    assert list(p.handleExpiredTimer((1,), h, None)) == [] and h.state is None and h.timers == [12, 20]
