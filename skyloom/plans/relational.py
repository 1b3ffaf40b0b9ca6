"""Sources, predicates, joins, aggregates, windows and text, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import text as T
from skyloom.operators import aggregates as A
from skyloom.operators import joins as J
from skyloom.operators import predicates as P
from skyloom.operators.components import link_components
from skyloom.plans.base import landing, query, sql_values, table, values
from skyloom.sources import landed as S

# ---------------------------------------------------------------- sources and sinks


@query(
    "s1_grouped_json",
    "SELECT CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END || '-' || (p_partkey // 1000) AS \"group\", count(*) AS n, sum(p_size)::BIGINT AS total FROM part GROUP BY 1",
)
def s1(spark: SparkSession, d: str) -> DataFrame:
    """One file of at most 1,000 records per group, named by it: each holds one JSON array."""
    path = landing(spark)
    group = F.concat_ws("-", F.when(F.col("p_size") > 25, "large").otherwise("small"), F.floor(F.col("p_partkey") / 1000))
    files = table(spark, d, "part").groupBy(F.concat(group, F.lit(".json")).alias("name")).agg(F.to_json(F.collect_list(F.struct("p_partkey", "p_size"))).alias("value"))
    S.land_texts(files, path)
    got = S.scan_grouped_json(spark, path, "p_partkey long, p_size int")
    return got.groupBy("group").agg(F.count("*").alias("n"), F.sum("p_size").alias("total"))


@query("s2_ledger_csv", "SELECT o_orderpriority AS kind, count(*) AS n, count(*) FILTER (o_orderstatus <> 'O') AS decayed FROM orders GROUP BY 1")
def s2(spark: SparkSession, d: str) -> DataFrame:
    path = landing(spark)
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.when(F.col("o_orderstatus") == "O", "").otherwise(F.col("o_orderstatus")).alias("decay_date"))
    o.write.option("header", True).csv(path)
    got = S.scan_ledger_csv(spark, path, "o_orderkey long, o_orderpriority string, decay_date string")
    return got.groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("n"), F.count("decay_date").alias("decayed"))


@query("s3_geojson", "SELECT c_custkey AS id, ((c_custkey * 7) % 360)::DOUBLE AS lon, ((c_custkey % 170) - 85)::DOUBLE AS lat, (c_custkey % 7)::DOUBLE AS mag FROM customer")
def s3(spark: SparkSession, d: str) -> DataFrame:
    path = landing(spark)
    c = table(spark, d, "customer")
    point = F.struct(
        F.col("c_custkey").cast("string").alias("id"),
        F.struct(F.array(((F.col("c_custkey") * 7) % 360).cast("double"), ((F.col("c_custkey") % 170) - 85).cast("double")).alias("coordinates")).alias("geometry"),
        F.struct((F.col("c_custkey") % 7).cast("double").alias("mag"), F.lit("0.5").alias("bv")).alias("properties"),
    )
    files = c.select(point.alias("f"), F.floor(F.col("c_custkey") / 1000).alias("k")).groupBy("k").agg(F.to_json(F.struct(F.collect_list("f").alias("features"))).alias("value"))
    files.write.partitionBy("k").text(path)
    return S.scan_geojson_points(spark, f"{path}/*").select(F.col("id").cast("long").alias("id"), "lon", "lat", "mag")


#: Ids whose lines are landed in one file, of about a megabyte.
LINES_A_FILE = 10_000


@query(
    "s3_geojson_lines",
    "WITH p AS (SELECT l_orderkey AS id, (l_orderkey % 2) * (l_linenumber % 2) AS seg, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_tax FROM lineitem)"
    " SELECT id, dense_rank() OVER (PARTITION BY id ORDER BY seg) - 1 AS seg, row_number() OVER (PARTITION BY id, seg ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice, l_tax) - 1 AS pos,"
    " (l_partkey % 360)::DOUBLE AS lon, (l_quantity - 25)::DOUBLE AS lat FROM p",
)
def s3_lines(spark: SparkSession, d: str) -> DataFrame:
    """Orders as lines, odd ones as multi-lines of two segments: landed as FeatureCollections and read again."""
    path = landing(spark)
    odd = F.col("l_orderkey") % 2 == 1
    line = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.when(odd, F.col("l_linenumber") % 2).otherwise(0).alias("seg"), "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_tax"
    )
    line = line.withColumn("xy", F.array((F.col("l_partkey") % 360).cast("double"), (F.col("l_quantity") - 25).cast("double")))
    nested = A.collect_ordered_nested(line.withColumn("pos", F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_tax")), "id", "seg", "pos", ["xy"])
    segs = F.transform("lines", lambda s: F.transform(s, lambda p: p[0]))
    shape = F.struct(F.when(F.col("id") % 2 == 1, "MultiLineString").otherwise("LineString").alias("type"), F.when(F.col("id") % 2 == 1, F.to_json(segs)).otherwise(F.to_json(F.get(segs, F.lit(0)))).alias("coordinates"))
    text = F.format_string('{"id":"%s","geometry":{"type":"%s","coordinates":%s}}', F.col("id").cast("string"), shape["type"], shape["coordinates"])
    files = nested.select(text.alias("f"), F.floor(F.col("id") / LINES_A_FILE).alias("k")).groupBy("k").agg(F.concat(F.lit('{"features":['), F.array_join(F.collect_list("f"), ","), F.lit("]}")).alias("value"))
    files.write.partitionBy("k").text(path)
    return S.scan_geojson_lines(spark, f"{path}/*").select(F.col("id").cast("long").alias("id"), "seg", "pos", "lon", "lat")


@query("s4_optional_source", "SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1")
def s4(spark: SparkSession, d: str) -> DataFrame:
    schema = "s_suppkey long, s_nationkey int"
    there = S.scan_optional(spark, f"{d}/supplier.parquet", schema, "parquet")
    gone = S.scan_optional(spark, f"{d}/no_such_source.json", schema)
    return there.unionByName(gone).groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"))


@query("s5_landed_extract", "SELECT p_brand, count(*) AS n, round(sum(p_retailprice), 2) AS total FROM part GROUP BY 1")
def s5(spark: SparkSession, d: str) -> DataFrame:
    path = landing(spark)
    table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice").write.option("header", True).csv(path)
    got = S.scan_landed_extract(spark, path, "p_partkey long, p_brand string, p_retailprice double")
    return got.groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total"))


@query("s6_snapshot", "SELECT 'part' AS name, count(*) AS n, '2026-08-22 02:05Z' AS stamp FROM part UNION ALL SELECT 'supplier', count(*), '2026-08-22 02:05Z' FROM supplier")
def s6(spark: SparkSession, d: str) -> DataFrame:
    ts = F.lit("2026-08-22 02:05:40").cast("timestamp")
    path = landing(spark)
    S.write_snapshot({n: S.stamp_snapshot(table(spark, d, n), ts) for n in ("part", "supplier")}, path, "20260822T0205Z", least=1)
    out = A.union_groups({n: S.read_snapshot(spark, path, n).select("stamp") for n in ("part", "supplier")})
    return out.groupBy(F.col("group").alias("name"), "stamp").agg(F.count("*").alias("n"))


@query("a9_gated_publish", "SELECT 'old' AS generation, (SELECT count(*) FROM part) AS parts, count(*) AS suppliers FROM supplier")
def a9(spark: SparkSession, d: str) -> DataFrame:
    """A second generation whose suppliers are too few is not published: readers keep the first one, both tables of it."""
    path = landing(spark)
    tables = {n: table(spark, d, n).withColumn("generation", F.lit("old")) for n in ("part", "supplier")}
    rows = S.write_snapshot(tables, path, "1", least=1)
    fewer = {"part": tables["part"].withColumn("generation", F.lit("new")), "supplier": tables["supplier"].where("s_suppkey % 2 = 0").withColumn("generation", F.lit("new"))}
    try:
        S.write_snapshot(fewer, path, "2", least=rows)
    except ValueError:
        pass
    of = {n: S.read_snapshot(spark, path, n).groupBy("generation").agg(F.count("*").alias(f"{n}s")) for n in tables}
    return of["part"].join(of["supplier"], "generation")


@query("s8_positional_records", "SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderstatus END AS status FROM orders")
def s8(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("status"))
    rec = S.to_positional(o, ["o_orderkey", "o_orderpriority", "status"]).select("record")
    return S.from_positional(rec, "record", {"o_orderkey": "long", "o_orderpriority": "string", "status": "string"}).drop("record")


# ---------------------------------------------------------------- predicates


P1_ANGLES = {"inclination": 7.0, "ra_of_asc_node": 9.0, "arg_of_pericenter": 11.0, "mean_anomaly": 13.0}


@query(
    "p1_normalise_elements",
    "SELECT trim('  ' || o_orderpriority || '/' || o_orderkey || ' ') AS name, epoch_ms(o_orderdate) AS epoch_ms, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 1957 + o_orderkey % 60 END AS launch_year,"
    " round(o_orderkey / 73.0::DOUBLE, 8) AS mean_motion, round(o_orderkey / 7e6::DOUBLE, 7) AS ecc,"
    " round(o_orderkey / 7.0::DOUBLE, 4) AS inc, round(o_orderkey / 9.0::DOUBLE, 4) AS raan, round(o_orderkey / 11.0::DOUBLE, 4) AS argp, round(o_orderkey / 13.0::DOUBLE, 4) AS ma FROM orders",
)
def p1(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    year = F.concat((F.lit(1957) + key % 60).cast("string"), F.lit("-001A"))
    raw = o.select(
        F.concat(F.lit("  "), "o_orderpriority", F.lit("/"), key, F.lit(" ")).alias("object_name"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("epoch"),
        (key / 73.0).alias("mean_motion"), (key / 7e6).alias("eccentricity"), *((key / n).alias(c) for c, n in P1_ANGLES.items()),
        F.when(key % 10 == 0, "").otherwise(year).alias("object_id"),
    )
    return P.normalise_elements(raw).withColumn("launch_year", F.col("launch_year").cast("long")).drop("object_id")


@query("p2_on_orbit", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'")
def p2(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("decay_date", F.when(F.col("o_orderstatus") == "O", "").otherwise(F.col("o_orderstatus")))
    return P.filter_on_orbit(o).select("o_orderkey")


@query("p3_prefix_and_type", "SELECT o_orderkey FROM orders WHERE starts_with(o_orderpriority, '1-') AND o_orderstatus = 'F'")
def p3(spark: SparkSession, d: str) -> DataFrame:
    return P.filter_prefix_and_type(table(spark, d, "orders"), "o_orderpriority", "1-", "o_orderstatus", "F").select("o_orderkey")


@query(
    "p4_prefixed_ids",
    "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey END AS num FROM customer",
)
def p4(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumn("id", F.concat(F.when(F.col("c_custkey") % 3 == 0, "NGC ").otherwise("M "), F.col("c_custkey").cast("string")))
    return c.select("c_custkey", P.parse_prefixed_id("id", "M ").cast("long").alias("num"))


@query(
    "p5_tolerant_numbers",
    "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0.5 WHEN event_id % 4 = 1 THEN 0.5 ELSE try_cast(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) END AS bv FROM events",
)
def p5(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    raw = F.when(F.col("event_id") % 4 == 0, "").when(F.col("event_id") % 4 == 1, "abc").otherwise(F.regexp_extract("props", "([0-9]+)", 1))
    return e.withColumn("raw", raw).select("event_id", P.tolerant_number("raw", 0.5).alias("bv"))


SKY = "SELECT c_custkey, (c_custkey * 137.50776::DOUBLE) % 360 AS ra, (c_custkey * 7 % 171) - 85.0::DOUBLE AS dec, 1 + (c_custkey % 70) / 10.0::DOUBLE AS mag FROM customer"
ECL = """sky2 AS (SELECT *, radians(ra) AS r, radians(dec) AS dd, radians(23.4392911::DOUBLE) AS e FROM sky),
ecl AS (SELECT c_custkey, mag, degrees(asin(greatest(-1, least(1, sin(dd) * cos(e) - cos(dd) * sin(e) * sin(r))))) AS beta,
        degrees(atan2(sin(r) * cos(e) + tan(dd) * sin(e), cos(r))) AS l FROM sky2)"""


def sky(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k, ((k * F.lit(137.50776)) % 360).alias("ra"), ((k * 7 % 171) - F.lit(85.0)).alias("dec"), (1 + (k % 70) / F.lit(10.0)).alias("mag"))


@query("p6_precut", f"WITH sky AS ({SKY}) SELECT c_custkey FROM sky WHERE mag <= 6.5")
def p6(spark: SparkSession, d: str) -> DataFrame:
    return P.precut(sky(spark, d), 6.5).select("c_custkey")


@query(
    "p7_depth_ramp",
    f"WITH sky AS ({SKY}), {ECL} SELECT c_custkey, round(beta, 3) AS beta FROM ecl WHERE beta >= -85 AND mag <= 6.0 + 1.5 * least(1, greatest(0, (10 - beta) / 95)) AND mag <= 7.5",
)
def p7(spark: SparkSession, d: str) -> DataFrame:
    from skyloom.operators.sky import equatorial_to_ecliptic

    df = equatorial_to_ecliptic(P.precut(sky(spark, d), 7.5), "ra", "dec")
    return P.filter_depth_ramp(df).select("c_custkey", F.round("beta", 3).alias("beta"))


@query("p8_alert_filter", "SELECT event_id FROM events WHERE event_type IN ('error', 'purchase') AND value > 30")
def p8(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumns({"severity": F.col("event_type"), "urgency": F.when(F.col("value") > 30, "Immediate").otherwise("Future")})
    return P.filter_alerts(e, ("error", "purchase")).select("event_id")


RULES = [("thther.example.org", 60), ("blog.tionsh.example.net", 600), ("m.ththth.example.net", 300)]
REQ_SQL = f"""
WITH rules AS (SELECT * FROM {sql_values(RULES, 'v', 'host, ttl')}),
r AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'OPTIONS' WHEN 1 THEN 'POST' ELSE 'GET' END AS method,
      CASE page_id % 11 WHEN 0 THEN NULL WHEN 1 THEN 'not a url' WHEN 2 THEN 'ftp://a.example/x' ELSE url END AS url,
      try_cast(regexp_extract(url, 'page=([0-9]+)', 1) AS INTEGER) * 100 AS override FROM pages),
h AS (SELECT *, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) AS host,
      lower(regexp_extract(coalesce(url, ''), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme FROM r),
o AS (SELECT page_id, h.host, CASE WHEN method = 'OPTIONS' THEN 'preflight' WHEN method <> 'GET' THEN '405' WHEN url IS NULL OR url = '' THEN 'health'
      WHEN scheme = '' OR h.host = '' THEN '400' WHEN scheme NOT IN ('http', 'https') THEN '400' WHEN rules.host IS NULL THEN '403' ELSE 'pass' END AS outcome,
      override, ttl FROM h LEFT JOIN rules ON rules.host = h.host)
"""


def requests(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    return table(spark, d, "pages").select(
        k,
        F.when(k % 7 == 0, "OPTIONS").when(k % 7 == 1, "POST").otherwise("GET").alias("method"),
        F.when(k % 11 == 0, None).when(k % 11 == 1, "not a url").when(k % 11 == 2, "ftp://a.example/x").otherwise(F.col("url")).alias("url"),
        (F.regexp_extract("url", "page=([0-9]+)", 1).try_cast("int") * 100).alias("override"),
    )


def rules_table(spark: SparkSession) -> DataFrame:
    return values(spark, RULES, "host string, ttl int")


@query("p9_admit_requests", REQ_SQL + "SELECT outcome, count(*) AS n FROM o GROUP BY 1")
def p9(spark: SparkSession, d: str) -> DataFrame:
    return P.admit_requests(requests(spark, d), rules_table(spark)).groupBy("outcome").agg(F.count("*").alias("n"))


@query("p10_resolve_ttl", REQ_SQL + "SELECT page_id, CASE WHEN override > 0 THEN least(override, 86400) ELSE coalesce(ttl, 300) END AS ttl FROM o WHERE outcome = 'pass'")
def p10(spark: SparkSession, d: str) -> DataFrame:
    passed = P.admit_requests(requests(spark, d), rules_table(spark)).where("outcome = 'pass'")
    return J.lookup(passed, rules_table(spark), "host", "ttl").select("page_id", P.resolve_ttl(F.col("override"), F.col("ttl")).alias("ttl"))


@query(
    "p11_scales_and_grades",
    """SELECT p_partkey, (p_size - 1) / 49.0 * 100 AS pct, CASE WHEN p_size >= 14 THEN least(-300.0::DOUBLE, -100.0::DOUBLE + p_size - 20) END AS axis_lo, CASE WHEN p_size >= 14 THEN greatest(900.0::DOUBLE, -100.0::DOUBLE + p_size * 20 + 20) END AS axis_hi,
    CASE WHEN p_size >= 1 THEN floor(p_retailprice / 2 * p_size / 100 + 0.5)::BIGINT END AS thickness, p_retailprice * 2 / (2 * p_size) AS width,
    CASE WHEN p_size / 50.0 >= 0.55 THEN 'good' WHEN p_size / 50.0 >= 0.10 THEN 'small' ELSE 'barely resolved' END AS grade,
    CASE WHEN p_size * 3 >= 137 THEN 'C5' WHEN p_size * 3 >= 113 THEN 'C4' WHEN p_size * 3 >= 96 THEN 'C3' WHEN p_size * 3 >= 83 THEN 'C2' WHEN p_size * 3 >= 64 THEN 'C1' WHEN p_size * 3 >= 34 THEN 'TS' ELSE 'TD' END AS tier,
    CASE WHEN p_size * 2 > 60 THEN 'high' WHEN p_size * 2 >= 40 THEN 'medium' ELSE 'low' END AS chance FROM part""",
)
def p11(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    lo, hi = P.temperature_axis(F.lit(-100.0) + s, F.when(s >= 14, F.lit(-100.0) + s * 20).otherwise(F.lit(-90.0) + s))
    return table(spark, d, "part").select(
        "p_partkey", P.scale_linear(s, 1, 50.0).alias("pct"), lo.alias("axis_lo"), hi.alias("axis_hi"), P.layer_thickness(F.col("p_retailprice"), s).alias("thickness"),
        P.required_source_width(F.col("p_retailprice"), s).alias("width"), P.grade_coverage(s / 50.0).alias("grade"), P.storm_tier(s * 3).alias("tier"), P.probability_tier(s * 2).alias("chance"),
    )


# ---------------------------------------------------------------- joins


@query(
    "j1_join_catalogue",
    "SELECT c_custkey, c_nationkey AS k, n_name, n_suppliers FROM customer JOIN nation ON c_nationkey = n_nationkey"
    " LEFT JOIN (SELECT s_nationkey, count(*) AS n_suppliers FROM supplier GROUP BY 1) ON s_nationkey = c_nationkey WHERE c_name LIKE 'Customer#%1'",
)
def j1(spark: SparkSession, d: str) -> DataFrame:
    ident = table(spark, d, "customer").withColumnRenamed("c_nationkey", "k")
    basic = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    flux = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n_suppliers"))
    return J.join_catalogue(ident, basic, flux, "k", "Customer#%1", "c_name").select("c_custkey", "k", "n_name", "n_suppliers")


BRANDS = [("Brand#11", 60), ("Brand#23", 900)]


@query("j2_lookup", f"SELECT p_partkey, coalesce(ttl, 300) AS ttl FROM part LEFT JOIN {sql_values(BRANDS, 'b', 'brand, ttl')} ON brand = p_brand")
def j2(spark: SparkSession, d: str) -> DataFrame:
    return J.lookup(table(spark, d, "part"), values(spark, BRANDS, "p_brand string, ttl int"), "p_brand", "ttl", 300).select("p_partkey", "ttl")


@query("j3_allowlist", REQ_SQL + "SELECT page_id, host IN (SELECT host FROM rules) AS allowed FROM h")
def j3(spark: SparkSession, d: str) -> DataFrame:
    r, rules = P.admit_requests(requests(spark, d), rules_table(spark)), rules_table(spark)
    yes = J.allowlist(r, rules).select("page_id", F.lit(True).alias("allowed"))
    return yes.unionByName(J.rejected(r, rules).select("page_id", F.lit(False).alias("allowed")))


@query(
    "j4_append_missing",
    "SELECT s_suppkey AS k, s_suppkey AS id, false AS appended FROM supplier UNION ALL"
    " SELECT c_custkey // 2, min(c_custkey), true FROM customer WHERE c_custkey // 2 NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1",
)
def j4(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "supplier").select(F.concat(F.lit(" "), F.col("s_suppkey").cast("string")).alias("name"), F.col("s_suppkey").cast("long").alias("id"))
    extra = table(spark, d, "customer").select(F.concat(F.floor(F.col("c_custkey") / 2).cast("string"), F.lit(" ")).alias("name"), F.col("c_custkey").cast("long").alias("id"))
    return J.append_missing(base, extra, "name", "id").select(F.trim("name").cast("long").alias("k"), "id", "appended")


@query(
    "j5_prefix_events",
    "WITH e AS (SELECT DISTINCT substr(p_name, 1, 8) AS prefix FROM part WHERE length(p_name) >= 8) SELECT prefix AS event_key, count(*) AS ever, count(*) FILTER (p_size > 25) AS up"
    " FROM part JOIN e ON starts_with(p_name, prefix) GROUP BY 1",
)
def j5(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").where(F.length("p_name") >= 8)
    events = part.select(F.substring("p_name", 1, 8).alias("prefix")).distinct().withColumn("event_key", F.col("prefix"))
    return A.ever_vs_current(J.prefix_event_join(part, events, "p_name").withColumn("up", F.col("p_size") > 25), "event_key", "up")


@query(
    "j7_event_proximity",
    """WITH e AS (SELECT DISTINCT user_id, date_trunc('day', ts) AS day FROM events),
    o AS (SELECT o_orderkey, o_custkey % 150 AS user_id, o_orderdate + INTERVAL 9000 DAY AS now FROM orders),
    n AS (SELECT o_orderkey, floor((epoch(day) - epoch(now)) / 86400 + 0.5)::BIGINT AS days FROM o JOIN e USING (user_id))
    SELECT o_orderkey, first(days ORDER BY abs(days), -days) AS days FROM n WHERE days >= -30 AND days < 180 GROUP BY 1""",
)
def j7(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day")).distinct()
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 150).alias("user_id"), F.expr("CAST(o_orderdate AS timestamp) + INTERVAL 9000 DAY").alias("now"))
    return J.event_proximity_join(o, e, "user_id", "now", "day").select("o_orderkey", "days")


SHOWERS = [("quadrantids", 1228, 112), ("lyrids", 416, 425), ("perseids", 717, 824), ("geminids", 1204, 1217), ("one day", 704, 704)]


@query(
    "j8_calendar_windows",
    f"SELECT name, count(*) AS n FROM orders JOIN {sql_values(SHOWERS, 'w', 'name, s, e')} ON CASE WHEN s <= e THEN month(o_orderdate) * 100 + day(o_orderdate) BETWEEN s AND e"
    " ELSE month(o_orderdate) * 100 + day(o_orderdate) >= s OR month(o_orderdate) * 100 + day(o_orderdate) <= e END GROUP BY 1",
)
def j8(spark: SparkSession, d: str) -> DataFrame:
    w = values(spark, SHOWERS, "name string, md_start int, md_end int")
    return J.calendar_window_join(table(spark, d, "orders"), w, "o_orderdate").groupBy("name").agg(F.count("*").alias("n"))


@query(
    "j11_drift_check",
    "SELECT s_suppkey, round(CASE WHEN s_suppkey % 5 = 0 THEN 0.01 ELSE 0.001 END::DOUBLE, 4) AS drift, s_suppkey % 5 <> 0 AS ok FROM supplier WHERE s_suppkey % 7 <> 0"
    " UNION ALL SELECT s_suppkey, NULL, false FROM supplier WHERE s_suppkey % 7 = 0",
)
def j11(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", F.round("s_acctbal", 2).alias("v"))
    new = s.where("s_suppkey % 7 <> 0").withColumn("v", F.col("v") + F.when(F.col("s_suppkey") % 5 == 0, 0.01).otherwise(0.001))
    return J.drift_check(s, new, "s_suppkey", "v", 0.003).select("s_suppkey", F.round("drift", 4).alias("drift"), "ok")


POLICY = [(f"src{i}", "CC BY-SA" if i % 3 == 0 else "public", i % 3 == 0) for i in range(15)]


@query(
    "j12_licence_gate",
    f"SELECT doc_id, licence, coalesce(NOT (sa AND doc_id % 2 = 0), false) AS accepted FROM documents LEFT JOIN {sql_values(POLICY, 'p', 'src, licence, sa')} ON src = source",
)
def j12(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", (F.col("doc_id") % 2 == 0).alias("derived"))
    return J.licence_gate(docs, values(spark, POLICY, "source string, licence string, share_alike boolean")).select("doc_id", "licence", "accepted")


# ---------------------------------------------------------------- aggregates and windows


@query("a1_totals_by_group", "SELECT p_type, count(*) AS total FROM part GROUP BY 1")
def a1(spark: SparkSession, d: str) -> DataFrame:
    return A.count_by_type(table(spark, d, "part"), "p_type")


@query(
    "a4_ledger_summary",
    "SELECT count(*) AS on_orbit, count(*) FILTER (o_orderstatus = 'O') AS pay, count(*) FILTER (o_orderstatus = 'X') AS other,"
    " (SELECT count(*) FROM orders WHERE o_orderpriority = '2-HIGH') AS ever, (SELECT count(*) FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderstatus = 'O') AS up FROM orders",
)
def a4(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("now", F.col("o_orderstatus") == "O")
    per = A.ever_vs_current(o, "o_orderpriority", "now").withColumnRenamed("o_orderpriority", "event_key")
    s = A.ledger_summary(o, "o_orderstatus", ["O", "X"], per)
    high = F.element_at("events", "2-HIGH")
    return s.select("on_orbit", F.col("n_0").alias("pay"), F.col("n_1").alias("other"), high["ever"].alias("ever"), high["up"].alias("up"))


@query("a5_groups_having_mean", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING avg(s_acctbal) > 4500)")
def a5(spark: SparkSession, d: str) -> DataFrame:
    return A.groups_having_mean(table(spark, d, "supplier"), "s_nationkey", "s_acctbal", 4500.0).select("s_suppkey")


@query(
    "a6_nested_round_trip",
    "SELECT o_custkey, dense_rank() OVER (PARTITION BY o_custkey ORDER BY l_orderkey) - 1 AS seg, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_tax) - 1 AS pos, l_quantity"
    " FROM lineitem JOIN orders ON o_orderkey = l_orderkey",
)
def a6(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    nested = A.collect_ordered_nested(lines, "o_custkey", "l_orderkey", "l_linenumber", ["l_quantity", "l_tax"])
    segs = T.explode_nested(nested, "lines").select("o_custkey", F.col("pos").alias("seg"), F.col("item").alias("points"))
    return segs.select("o_custkey", "seg", F.posexplode("points").alias("pos", "p")).select("o_custkey", F.col("seg").cast("long").alias("seg"), F.col("pos").cast("long").alias("pos"), F.col("p")[0].alias("l_quantity"))


@query("a10_dedupe_first", "SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY text")
def a10(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.coalesce(F.sha2("text", 256), F.lit("null")).alias("digest"))
    first = A.dedupe_first(docs, "digest", ["doc_id"])
    return first.join(docs.groupBy("digest").agg(F.count("*").alias("n")), "digest").select("doc_id", "n")


@query("a11_savings", "SELECT round(sum(l_extendedprice), 2) AS before, round(sum(l_extendedprice * (1 - l_discount)), 2) AS after, round((1 - sum(l_extendedprice * (1 - l_discount)) / sum(l_extendedprice)) * 100, 2) AS saved_pct FROM lineitem")
def a11(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return A.savings_summary(li, "l_extendedprice", "net").select(F.round("before", 2).alias("before"), F.round("after", 2).alias("after"), "saved_pct")


GRID = "g AS (SELECT event_type AS image_id, hour(ts) AS x, day(ts) AS y, count(*) AS lum FROM events GROUP BY ALL HAVING count(*) > 3)"


def grid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("image_id"), F.hour("ts").alias("x"), F.dayofmonth("ts").alias("y")).agg(F.count("*").alias("lum"))


COMP_SQL = f"""WITH RECURSIVE {GRID}, e AS (SELECT a.image_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by FROM g a JOIN g b USING (image_id) WHERE abs(a.x - b.x) + abs(a.y - b.y) = 1),
reach AS (SELECT image_id, x, y, y * 1000 + x AS c FROM g UNION SELECT e.image_id, e.bx, e.by, reach.c FROM reach JOIN e ON e.image_id = reach.image_id AND e.ax = x AND e.ay = y),
lab AS (SELECT image_id, x, y, min(c) AS c FROM reach GROUP BY ALL),
box AS (SELECT image_id, c, count(*) AS area, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM lab GROUP BY 1, 2)
"""


@query("a7_component_boxes", COMP_SQL + "SELECT image_id, area, min_x, max_x, min_y, max_y FROM box")
def a7(spark: SparkSession, d: str) -> DataFrame:
    return A.component_bbox(A.components_of_cells(grid(spark, d), 3, link_components)).drop("comp", "seed")


@query("w3_pick_largest", COMP_SQL + "SELECT image_id, area, min_y, min_x FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, c) AS r FROM box) WHERE r = 1")
def w3(spark: SparkSession, d: str) -> DataFrame:
    boxes = A.component_bbox(A.components_of_cells(grid(spark, d), 3, link_components))
    return A.pick_largest(boxes, "image_id", [F.desc("area"), "seed"]).select("image_id", "area", "min_y", "min_x")


@query("w1_running_ranges", 'SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice, l_tax ROWS UNBOUNDED PRECEDING) - l_quantity AS start, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice, l_tax ROWS UNBOUNDED PRECEDING) AS "end" FROM lineitem')
def w1(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumn("pos", F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_tax"))
    return A.running_ranges(li, "l_orderkey", "pos", "l_quantity").select("l_orderkey", "l_linenumber", "start", "end")


@query(
    "w2_systematic_sample",
    "WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders),"
    " k AS (SELECT DISTINCT o_orderstatus, floor(k * (n / 400.0::DOUBLE))::BIGINT AS i FROM r, range(400) t(k) WHERE n > 400)"
    " SELECT r.o_orderkey FROM r JOIN k USING (o_orderstatus, i) UNION ALL SELECT o_orderkey FROM r WHERE n <= 400",
)
def w2(spark: SparkSession, d: str) -> DataFrame:
    caps = values(spark, [("O", 400), ("F", 400), ("P", 400)], "o_orderstatus string, cap int")
    return A.systematic_sample(table(spark, d, "orders"), "o_orderstatus", "o_orderkey", caps).select("o_orderkey")


@query("o1_brightest_first", "SELECT p_partkey, p_retailprice FROM part ORDER BY round(p_retailprice, 1), p_partkey LIMIT 100")
def o1(spark: SparkSession, d: str) -> DataFrame:
    return A.brightest_first(table(spark, d, "part"), "p_retailprice", ["p_partkey"], 100).select("p_partkey", "p_retailprice")


@query("o2_sorted_keys", "SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey")
def o2(spark: SparkSession, d: str) -> DataFrame:
    return A.sort_by_key(table(spark, d, "supplier"), "s_suppkey").select("s_suppkey", "s_name")


@query("o3_shuffle_rows", "SELECT p_partkey, md5('42/' || p_partkey) AS place FROM part ORDER BY place")
def o3(spark: SparkSession, d: str) -> DataFrame:
    return A.shuffle_rows(table(spark, d, "part"), "p_partkey", 42).select("p_partkey", A.shuffle_key("p_partkey", 42).alias("place"))


@query("u1_union_groups", "SELECT 'customer' AS \"group\", 0 AS group_pos, count(*) AS n FROM customer UNION ALL SELECT 'supplier', 1, count(*) FROM supplier")
def u1(spark: SparkSession, d: str) -> DataFrame:
    both = A.union_groups({"customer": table(spark, d, "customer").select(F.col("c_name").alias("name")), "supplier": table(spark, d, "supplier").select(F.col("s_name").alias("name"))})
    return both.groupBy("group", "group_pos").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- text


@query(
    "t1_classify",
    "SELECT doc_id, CASE WHEN lang = 'en' THEN 'glob' WHEN regexp_matches(source, '^src1') THEN 'gal' ELSE 'neb' END AS kind FROM documents",
)
def t1(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("key", F.concat_ws("|", "lang", "source"))
    return docs.select("doc_id", T.classify_first_match(F.col("key"), [(r"^en\|", "glob"), (r"\|src1", "gal")], "neb").alias("kind"))


@query("t1_classify_by_table", "SELECT p_partkey, CASE WHEN regexp_matches(lower(p_type), 'steel') THEN 'Solid' WHEN regexp_matches(lower(p_type), 'brass|copper') THEN 'Liquid' ELSE 'Gas' END AS label FROM part")
def t1b(spark: SparkSession, d: str) -> DataFrame:
    rules = values(spark, [("label", 1, "steel", "Solid"), ("label", 2, "brass|copper", "Liquid")], RULE)
    return T.classify_by_table(table(spark, d, "part"), {"label": "p_type"}, rules, {"label": "Gas"}).select("p_partkey", "label")


#: Rule sets of our own over pages and their urls: theme of the text, kind of the url, agency by host, tab.
RULE_SETS = [
    ("theme", 1, "list|table", "Lists"), ("theme", 2, "price|offer|sale", "Trade"), ("theme", 3, "script", "Scripted"),
    ("kind", 1, r"\?.*page=", "paged"), ("kind", 2, r"\.html", "file"), ("kind", 3, "#", "anchor"), ("kind", 4, "/$", "folder"),
    ("agency", 1, r"://m\.", "mobile"), ("agency", 2, r"://(www|blog)\.", "classic"), ("agency", 3, r"\.org", "public"),
    ("tab", 1, "/(en|de)/", "1"), ("tab", 2, "/(fr|es)/", "2"),
]
RULE = "rule_set string, priority int, pattern string, label string"
SET_OF = {"theme": "html", "kind": "url", "agency": "url", "tab": "url"}
SET_DEFAULT = {"theme": "Plain", "kind": "page", "agency": "private", "tab": "0"}


def rule_sets_sql() -> str:
    case = lambda s: " ".join(f"WHEN regexp_matches(lower({SET_OF[s]}), '{p}') THEN '{x}'" for n, _, p, x in RULE_SETS if n == s)
    return f"SELECT page_id, {', '.join(f'CASE {case(s)} ELSE {chr(39)}{SET_DEFAULT[s]}{chr(39)} END AS {s}' for s in SET_OF)} FROM pages"


@query("t1_rule_sets", rule_sets_sql())
def t1_sets(spark: SparkSession, d: str) -> DataFrame:
    return T.classify_by_table(table(spark, d, "pages"), SET_OF, values(spark, RULE_SETS, RULE), SET_DEFAULT).select("page_id", *SET_OF)


def measures(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size").cast("string")
    text = F.concat(F.lit("Temp ~"), s, F.lit("0 °F, "), s, F.lit(".5 GPa, 1,"), F.lpad(s, 3, "0"), F.lit(" km deep, night -"), s, F.lit(" to "), s)
    return table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 5, text).otherwise("nothing here").alias("text"))


@query("t2_measurements", "SELECT p_partkey, 'TEMP' AS label, '~' || p_size || '0°F' AS value FROM part WHERE p_size > 5 UNION ALL SELECT p_partkey, 'PRESSURE', '~' || p_size || '.5 GPa' FROM part WHERE p_size > 5")
def t2(spark: SparkSession, d: str) -> DataFrame:
    return T.extract_measurements(measures(spark, d), "text").select("p_partkey", "label", "value")


@query(
    "t3_convert_units",
    "SELECT p_partkey, CASE WHEN p_size > 5 THEN 'Temp ~' || p_size || '0 °F, ' || p_size || '.5 GPa, ' || floor((1000 + p_size) * 0.621371 + 0.5)::INTEGER || ' mi deep, night -' || p_size || ' to ' || p_size ELSE 'nothing here' END AS text FROM part",
)
def t3(spark: SparkSession, d: str) -> DataFrame:
    return measures(spark, d).select("p_partkey", T.convert_units_in_text("text").alias("text"))


@query("t4_temperature_range", "SELECT p_partkey, CASE WHEN p_size > 5 THEN -p_size END AS lo, CASE WHEN p_size > 5 THEN greatest(p_size * 10, p_size) END AS hi, CASE WHEN p_size > 5 THEN 'NIGHT' ELSE 'COLD' END AS lo_label FROM part")
def t4(spark: SparkSession, d: str) -> DataFrame:
    df = measures(spark, d).withColumn("text", F.regexp_replace("text", r"\.5 GPa, 1,\d+", ""))
    return T.temperature_range(df, "text").select("p_partkey", "lo", "hi", "lo_label")


UNIT = "(?:the|to|le|la|de|of|by)"


@query(
    "t2_measurements_in_documents",
    f"SELECT doc_id, 'COUNTED' AS label, '~' || regexp_extract(text, '(?:^|[^0-9.,])([0-9]+(?:,[0-9]+)*(?:[.][0-9]+)?(?:\\s?[-–]\\s?[0-9]+(?:,[0-9]+)*(?:[.][0-9]+)?)?)\\s*{UNIT}\\b', 1) AS value FROM documents"
    f" WHERE regexp_matches(text, '(?:^|[^0-9.,])([0-9]+(?:,[0-9]+)*(?:[.][0-9]+)?(?:\\s?[-–]\\s?[0-9]+(?:,[0-9]+)*(?:[.][0-9]+)?)?)\\s*{UNIT}\\b')",
)
def t2_docs(spark: SparkSession, d: str) -> DataFrame:
    """Prose with numbers of any shape, ahead of small words in place of units."""
    return T.extract_measurements(table(spark, d, "documents").select("doc_id", "text"), "text", [("COUNTED", f"{UNIT}{T.END}", "")]).select("doc_id", "label", "value")


@query(
    "t3_convert_units_in_documents",
    f"WITH p AS (SELECT doc_id, text, '(?i)(^|[^0-9.,])([0-9]+(?:,[0-9]+)*(?:[.][0-9]+)?)\\s*{UNIT}\\b' AS pat FROM documents),"
    " q AS (SELECT doc_id, regexp_split_to_array(text, pat) AS parts, regexp_extract_all(text, pat, 1) AS ahead, regexp_extract_all(text, pat, 2) AS n FROM p)"
    " SELECT doc_id, md5(array_to_string(list_transform(range(1, len(parts) + 1), lambda i: parts[i] || coalesce(ahead[i] || format('{:,}', floor(replace(n[i], ',', '')::DOUBLE * 0.5::DOUBLE + 0.5::DOUBLE)::BIGINT) || ' pairs', '')), '')) AS text FROM q",
)
def t3_docs(spark: SparkSession, d: str) -> DataFrame:
    text = T.convert_units_in_text("text", f"{UNIT}{T.END}", 0.5, " pairs")
    return table(spark, d, "documents").select("doc_id", F.md5(text).alias("text"))


@query("t4_ranges_in_documents", "SELECT doc_id, CASE WHEN len(n) >= 2 THEN list_min(n) END AS lo, CASE WHEN len(n) >= 2 THEN list_max(n) END AS hi FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '-?[0-9]+'), lambda x: try_cast(x AS BIGINT)), lambda x: x IS NOT NULL) AS n FROM documents)")
def t4_docs(spark: SparkSession, d: str) -> DataFrame:
    return T.temperature_range(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "lo", "hi")


@query("t5_extract_between", "SELECT page_id, substr(html, strpos(html, '<title>') + 7, strpos(html, '</title>') - strpos(html, '<title>') - 7) AS title FROM pages")
def t5(spark: SparkSession, d: str) -> DataFrame:
    good, bad = T.extract_between(table(spark, d, "pages"), "html", "<title>", "</title>", out="cut")
    title = F.expr("substring(cut, 8)")
    return good.select("page_id", title.alias("title")).unionByName(bad.select("page_id", F.lit(None).cast("string").alias("title")))


@query("t6_drop_between", "SELECT page_id, length(html) - CASE WHEN a > 0 AND b > 0 THEN b + 6 ELSE 0 END AS n FROM (SELECT *, strpos(html, '<head>') AS a, strpos(substr(html, strpos(html, '<head>') + 6), '</head>') + 6 AS b0, CASE WHEN b0 > 6 THEN b0 ELSE 0 END AS b FROM pages)")
def t6(spark: SparkSession, d: str) -> DataFrame:
    good, bad = T.drop_between(table(spark, d, "pages"), "html", "<head>", "</head>")
    whole = bad.select("page_id", F.length("html").cast("long").alias("n"))  # without both anchors nothing is dropped
    return good.select("page_id", F.length("rest").cast("long").alias("n")).unionByName(whole)


@query("t7_extract_pairs", """SELECT page_id, k AS key, v AS value FROM (SELECT page_id, unnest(regexp_extract_all(html, '(\\w+)="([^"]+)"', 1)) AS k, unnest(regexp_extract_all(html, '(\\w+)="([^"]+)"', 2)) AS v FROM pages)""")
def t7(spark: SparkSession, d: str) -> DataFrame:
    return T.extract_pairs(table(spark, d, "pages"), "html", r'(\w+)="([^"]+)"').select("page_id", "key", "value")


SECT = "s AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS section FROM conversations)"


@query("w5_sectionise", f"WITH {SECT} SELECT conv_id, turn, section, CASE WHEN section = 0 THEN 'hero' ELSE md5(first_value(text) OVER (PARTITION BY conv_id, section ORDER BY turn)) END AS title FROM s")
def w5(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").withColumn("text", F.md5("text"))
    return T.sectionise(c, "conv_id", "turn", F.col("role") == "user", "text").select("conv_id", "turn", "section", "title")


@query(
    "t8_route_sections",
    f"""WITH {SECT}, t AS (SELECT conv_id, section, CASE WHEN section = 0 THEN 'hero' ELSE first(text ORDER BY turn) END AS title FROM s GROUP BY conv_id, section),
    r AS (SELECT *, CASE WHEN regexp_matches(regexp_replace(lower(title), '[^a-z0-9 ]', '', 'g'), 'right now') THEN -1 WHEN regexp_matches(regexp_replace(lower(title), '[^a-z0-9 ]', '', 'g'), '^(the|th)') THEN 1
          WHEN regexp_matches(regexp_replace(lower(title), '[^a-z0-9 ]', '', 'g'), '^(an|in)') THEN 0 ELSE 2 END AS tab0 FROM t),
    g AS (SELECT conv_id, count(*) AS n, count(DISTINCT tab0) AS k FROM r GROUP BY 1)
    SELECT conv_id, CASE WHEN n < 2 OR k < 2 THEN 0 ELSE tab0 END AS tab, count(*) AS n, min(section) AS first FROM r JOIN g USING (conv_id) GROUP BY 1, 2""",
)
def t8(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    sections = T.sectionise(c, "conv_id", "turn", F.col("role") == "user", "text").select("conv_id", "section", "title").distinct()
    routed = T.route_sections(sections, "conv_id", [("^(the|th)", "1"), ("^(an|in)", "9")], "2", 3)
    return routed.select("conv_id", "tab", F.size("sections").cast("long").alias("n"), F.col("sections")[0].alias("first"))


@query("t11_version_key", "SELECT event_id, (dayofyear(ts) - 1) * 24 + hour(ts) AS k FROM events")
def t11(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", T.version_key(F.col("ts")).cast("long").alias("k"))
