"""Astronomy jobs and sky colours, over all dates of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions.text import hex_to_rgb, lerp_rgb, rgb_to_hex
from skyloom.operators import sky as K
from skyloom.operators.colour import LAYERS, STOPS, sky_gradient
from skyloom.operators.joins import bracket_join
from skyloom.plans.base import query, sql_values, table, values
from skyloom.plans.relational import ECL, SKY, sky


def elements_cte(name: str, source: str, e: tuple | None = None) -> str:
    """CTEs from `source` (with d) to x, y, z, r: the orbit in SQL, Newton's steps one by one."""
    at = lambda j: f"({e[2 * j]!r}::DOUBLE + {e[2 * j + 1]!r}::DOUBLE * (d + 1.5))" if e else f"({K.NAMES[j]}0 + {K.NAMES[j]}1 * (d + 1.5))"
    out = [
        f"{name}a AS (SELECT *, {at(0)} AS nd, {at(1)} AS ic, {at(2)} AS pr, {at(3)} AS ax, {at(4)} AS ec, radians(({at(5)} % 360 + 360) % 360) AS m FROM {source})",
        f"{name}e0 AS (SELECT *, m + ec * sin(m) AS ea FROM {name}a)",
    ]
    for k in range(K.NEWTON_STEPS):
        out.append(f"{name}e{k + 1} AS (SELECT * EXCLUDE ea, ea - (ea - ec * sin(ea) - m) / (1 - ec * cos(ea)) AS ea FROM {name}e{k})")
    out.append(f"{name}v AS (SELECT * EXCLUDE ea, ax * (cos(ea) - ec) AS xv, ax * sqrt(1 - ec * ec) * sin(ea) AS yv FROM {name}e{K.NEWTON_STEPS})")
    out.append(f"{name}w AS (SELECT * EXCLUDE (xv, yv), sqrt(xv * xv + yv * yv) AS r, radians(degrees(atan2(yv, xv)) + pr) AS v FROM {name}v)")
    out.append(
        f"{name} AS (SELECT * EXCLUDE (nd, ic, pr, ax, ec, m, v), r * (cos(radians(nd)) * cos(v) - sin(radians(nd)) * sin(v) * cos(radians(ic))) AS x,"
        f" r * (sin(radians(nd)) * cos(v) + cos(radians(nd)) * sin(v) * cos(radians(ic))) AS y, r * sin(v) * sin(radians(ic)) AS z FROM {name}w)"
    )
    return ", ".join(out)


INST = "inst AS (SELECT DISTINCT o_orderdate AS ts, epoch(o_orderdate) / 86400.0::DOUBLE + 2440587.5 - 2451545.0 AS d FROM orders)"
DAYS = "inst AS (SELECT DISTINCT date_trunc('day', ts)::TIMESTAMP AS ts, epoch(date_trunc('day', ts)) / 86400.0::DOUBLE + 2440587.5 - 2451545.0 AS d FROM events)"
SUN_SQL = f"{elements_cte('su', 'inst', K.SUN)}, sun AS (SELECT ts, d, x AS sx, y AS sy, z AS sz, r AS sr, (degrees(atan2(y, x)) + 360) % 360 AS sun_lon FROM su)"


def series(terms: list[tuple], f: str) -> str:
    arg = lambda k: " + ".join(f"{m} * {n}" for n, m in zip(("ad", "am", "asn", "af"), k, strict=True) if m)
    return " + ".join(f"({t[0]}::DOUBLE) * {f}(radians({arg(t[1:])}))" for t in terms)


_S, _M = K.SUN, K.MOON
MOON_SQL = f"""{elements_cte('mo', 'sun', K.MOON)},
m1 AS (SELECT *, {_S[10]!r}::DOUBLE + {_S[11]!r}::DOUBLE * (d + 1.5) AS ms, {_M[10]!r}::DOUBLE + {_M[11]!r}::DOUBLE * (d + 1.5) AS mm,
       {_S[4]!r}::DOUBLE + {_S[5]!r}::DOUBLE * (d + 1.5) AS ws, {_M[0]!r}::DOUBLE + {_M[1]!r}::DOUBLE * (d + 1.5) AS nn, {_M[4]!r}::DOUBLE + {_M[5]!r}::DOUBLE * (d + 1.5) AS wm FROM mo),
m2 AS (SELECT *, (((nn + wm + mm) - (ms + ws)) % 360 + 360) % 360 AS ad, (mm % 360 + 360) % 360 AS am, (ms % 360 + 360) % 360 AS asn, (((nn + wm + mm) - nn) % 360 + 360) % 360 AS af FROM m1),
moon AS (SELECT ts, d, sun_lon, ((degrees(atan2(y, x)) + {series(K.MOON_LON, 'sin')}) % 360 + 360) % 360 AS moon_lon,
         degrees(atan2(z, sqrt(x * x + y * y))) + {series(K.MOON_LAT, 'sin')} AS moon_lat, r + {series(K.MOON_RADII, 'cos')} AS moon_radii,
         {K.MEAN_KM!r} + {' + '.join(f"({a!r}::DOUBLE) * cos(radians((297.8501921 + 12.19074912::DOUBLE * d) * {k} + (134.9633964 + 13.06499295::DOUBLE * d) * {m}))" for a, k, m in K.MOON_KM)} AS moon_km FROM m2)"""


def steps(x: str, ladder: list[tuple], last: object, op: str = "<") -> str:
    cell = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return "CASE " + " ".join(f"WHEN {x} {op} {v} THEN {cell(n)}" for v, n in ladder) + f" ELSE {cell(last)} END"


PHASE_SQL = f"""ph0 AS (SELECT *, ((moon_lon - sun_lon) % 360 + 360) % 360 AS angle FROM moon),
ph AS (SELECT ts, angle, {steps('angle', K.PHASES, 'New Moon')} AS phase, floor((1 - cos(radians(angle))) / 2 * 100 + 0.5)::INTEGER AS illum, angle < 180 AS waxing,
       floor((180 - angle + 360) % 360 / 12.19 + 0.5)::INTEGER AS f0, floor((360 - angle) % 360 / 12.19 + 0.5)::INTEGER AS n0, moon_km FROM ph0)"""


def order_instants(spark: SparkSession, d: str) -> DataFrame:
    return K.with_julian_day(table(spark, d, "orders").select(F.col("o_orderdate").cast("timestamp").alias("ts")).distinct(), "ts")


def event_days(spark: SparkSession, d: str) -> DataFrame:
    return K.with_julian_day(table(spark, d, "events").select(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("ts")).distinct(), "ts")


@query(
    "e8_orders_by_moon_phase",
    f"WITH {INST}, {SUN_SQL}, {MOON_SQL}, {PHASE_SQL} SELECT phase, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN ph ON ph.ts = o_orderdate GROUP BY 1",
)
def e8_orders(spark: SparkSession, d: str) -> DataFrame:
    phases = K.moon_phase_calendar(order_instants(spark, d)).select("ts", "phase")
    orders = table(spark, d, "orders").withColumn("ts", F.col("o_orderdate").cast("timestamp"))
    return orders.join(phases, "ts").groupBy("phase").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))


@query(
    "e8_moon_calendar",
    f"WITH {INST}, {SUN_SQL}, {MOON_SQL}, {PHASE_SQL} SELECT ts, phase, illum, waxing, CASE WHEN f0 > 29 THEN 0 ELSE f0 END AS to_full, CASE WHEN n0 > 29 THEN 0 ELSE n0 END AS to_new,"
    f" {steps('illum', [(10, 0), (30, 1), (60, 2), (85, 3), (96, 4)], 5)} AS impact,"
    f" {steps('floor(floor(angle + 0.5) / 12.2 + 0.5)', [(v, i) for i, v in enumerate((3, 6, 9, 12, 15, 18, 22, 26))], 8, '<=')} AS terminator FROM ph",
)
def e8_calendar(spark: SparkSession, d: str) -> DataFrame:
    cal = K.moon_phase_calendar(order_instants(spark, d))
    return cal.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "phase", "illum", "waxing", "to_full", "to_new", "impact", "terminator")


@query("e1_julian_day", "SELECT DISTINCT o_orderdate AS ts, epoch(o_orderdate) / 86400.0 + 2440587.5 AS jd FROM orders")
def e1(spark: SparkSession, d: str) -> DataFrame:
    return order_instants(spark, d).select(F.col("ts").cast("timestamp_ntz").alias("ts"), "jd")


@query("e3_sun_positions", f"WITH {INST}, {SUN_SQL} SELECT ts, round(sun_lon, 4) AS sun_lon, round(sr, 6) AS sr FROM sun")
def e3(spark: SparkSession, d: str) -> DataFrame:
    return K.sun_positions(order_instants(spark, d)).select(F.col("ts").cast("timestamp_ntz").alias("ts"), F.round("sun_lon", 4).alias("sun_lon"), F.round("sr", 6).alias("sr"))


@query("e4_moon_positions", f"WITH {INST}, {SUN_SQL}, {MOON_SQL} SELECT ts, round(moon_lon, 3) AS lon, round(moon_lat, 3) AS lat, round(moon_radii, 3) AS radii, round(moon_km, 0) AS km FROM moon")
def e4(spark: SparkSession, d: str) -> DataFrame:
    m = K.moon_positions(K.sun_positions(order_instants(spark, d)))
    return m.select(
        F.col("ts").cast("timestamp_ntz").alias("ts"), F.round("moon_lon", 3).alias("lon"), F.round("moon_lat", 3).alias("lat"), F.round("moon_radii", 3).alias("radii"), F.round("moon_km", 0).alias("km")
    )


BODIES = "bodies AS (SELECT * FROM " + sql_values([(b, *map(float, e)) for b, e in K.ELEMENTS.items()], "b", "body, " + ", ".join(f"{n}{k}" for n in K.NAMES for k in "01")) + ")"
HELIO_SQL = f"{BODIES}, grid AS (SELECT * FROM sun, bodies), {elements_cte('he', 'grid')}"
APP_SQL = f"""{HELIO_SQL},
eq0 AS (SELECT ts, d, body, radians(23.4393 - 3.563e-7::DOUBLE * d) AS eps, x + sx AS gx, y + sy AS gy, z + sz AS gz, sx, sy, sz FROM he),
eq1 AS (SELECT *, gy * cos(eps) - gz * sin(eps) AS qy, gy * sin(eps) + gz * cos(eps) AS qz, sy * cos(eps) - sz * sin(eps) AS ty, sy * sin(eps) + sz * cos(eps) AS tz FROM eq0),
app AS (SELECT ts, d, body, (atan2(qy, gx) + 2 * pi()) % (2 * pi()) AS ra, atan2(qz, sqrt(gx * gx + qy * qy)) AS dec,
        (atan2(ty, sx) + 2 * pi()) % (2 * pi()) AS sra, atan2(tz, sqrt(sx * sx + ty * ty)) AS sdec FROM eq1)"""


@query("e2_heliocentric", f"WITH {DAYS}, {SUN_SQL}, {HELIO_SQL} SELECT ts, body, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z, round(r, 4) AS r FROM he")
def e2(spark: SparkSession, d: str) -> DataFrame:
    h = K.heliocentric_positions(K.elements_table(spark), event_days(spark, d))
    return h.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "body", *(F.round(c, 4).alias(c) for c in "xyzr"))


@query("e5_apparent", f"WITH {DAYS}, {SUN_SQL}, {APP_SQL} SELECT ts, body, round(degrees(ra), 3) AS ra, round(degrees(dec), 3) AS dec FROM app")
def e5(spark: SparkSession, d: str) -> DataFrame:
    a = K.apparent_positions(K.elements_table(spark), event_days(spark, d))
    return a.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "body", F.round(F.degrees("ra"), 3).alias("ra"), F.round(F.degrees("dec"), 3).alias("dec"))


def horizon_sql(name: str, source: str, day: str) -> str:
    t = f"(({day}) / 36525.0)"
    gmst = f"280.46061837 + 360.98564736629::DOUBLE * ({day}) + 0.000387933 * {t} * {t} - {t} * {t} * {t} / 38710000.0"
    return f"""{name}0 AS (SELECT *, radians(((({gmst} + 0.0) % 360 + 360) % 360 + lon + 360) % 360) - ra AS h, radians(lat) AS la FROM {source}),
{name}1 AS (SELECT *, asin(greatest(-1, least(1, sin(dec) * sin(la) + cos(dec) * cos(la) * cos(h)))) AS al FROM {name}0),
{name} AS (SELECT * EXCLUDE (h, la, al), degrees(al) AS alt, CASE WHEN sin(h) > 0 THEN 360 - degrees(acos(greatest(-1, least(1, (sin(dec) - sin(al) * sin(la)) / (cos(al) * cos(la))))))
  ELSE degrees(acos(greatest(-1, least(1, (sin(dec) - sin(al) * sin(la)) / (cos(al) * cos(la)))))) END AS az FROM {name}1)"""


OBS = "obs AS (SELECT n_nationkey AS obs_id, (n_nationkey * 6 - 72)::DOUBLE AS lat, (n_nationkey * 14 - 170)::DOUBLE AS lon FROM nation)"
REPORT_SQL = f"""WITH {DAYS}, {SUN_SQL}, {APP_SQL}, {OBS}, og AS (SELECT * FROM app, obs), {horizon_sql('h1', 'og', 'd')},
l0 AS (SELECT * RENAME (alt AS alt1, az AS az1) FROM h1), {horizon_sql('h2', 'l0', 'd + 30 / 1440.0::DOUBLE')},
rep AS (SELECT ts, body, obs_id, floor(alt1 + 0.5)::INTEGER AS alt_deg, floor(az1 + 0.5)::INTEGER AS az_deg, CASE WHEN alt > alt1 THEN 'rising' ELSE 'setting' END AS trend,
   degrees(acos(greatest(-1, least(1, sin(dec) * sin(sdec) + cos(dec) * cos(sdec) * cos(ra - sra))))) AS elongation FROM h2)
SELECT ts, body, obs_id, alt_deg, az_deg, trend, round(elongation, 2) AS elongation,
  (['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'])[(floor(az_deg / 22.5 + 0.5)::INTEGER % 16) + 1] AS direction,
  CASE WHEN alt_deg > 30 THEN 'Excellent' WHEN alt_deg > 20 THEN 'Good' WHEN alt_deg > 10 THEN 'Fair' WHEN alt_deg > 0 THEN 'Low' ELSE 'Below horizon' END AS quality FROM rep"""


@query("e7_observing_report", REPORT_SQL)
def e7(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    obs = table(spark, d, "nation").select(n.alias("obs_id"), (n * 6 - 72).cast("double").alias("lat"), (n * 14 - 170).cast("double").alias("lon"))
    rep = K.observing_report(K.apparent_positions(K.elements_table(spark), event_days(spark, d)), obs)
    return rep.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "body", "obs_id", "alt_deg", "az_deg", "trend", F.round("elongation", 2).alias("elongation"), "direction", "quality")


@query("e9_to_ecliptic", f"WITH sky AS ({SKY}), {ECL} SELECT c_custkey, round((l + 360) % 360, 3) AS lam, round(beta, 3) AS beta FROM ecl")
def e9(spark: SparkSession, d: str) -> DataFrame:
    return K.equatorial_to_ecliptic(sky(spark, d), "ra", "dec").select("c_custkey", F.round("lam", 3).alias("lam"), F.round("beta", 3).alias("beta"))


@query(
    "e10_galactic_places",
    """WITH s AS (SELECT c_custkey, (c_custkey * 4) % 360 AS l, ((c_custkey % 3) - 1) * 20 AS b FROM customer),
    q AS (SELECT *, radians(122.932 - l) AS df, radians(b) AS br, radians(27.1283::DOUBLE) AS g FROM s),
    t AS (SELECT c_custkey, 192.8595 + degrees(atan2(cos(br) * sin(df), sin(br) * cos(g) - cos(br) * sin(g) * cos(df))) AS ra, degrees(asin(cos(br) * cos(g) * cos(df) + sin(br) * sin(g))) AS dec FROM q)
    SELECT c_custkey, round((ra + 360) % 360, 3) AS ra, round(dec, 3) AS dec FROM t""",
)
def e10(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(k, ((k * 4) % 360).cast("double").alias("gl"), (((k % 3) - 1) * 20).cast("double").alias("gb"))
    return K.galactic_to_equatorial(c, "gl", "gb").select("c_custkey", F.round("ra", 3).alias("ra"), F.round("dec", 3).alias("dec"))


@query(
    "e10_galactic_grid",
    """WITH s AS (SELECT n_nationkey, l::DOUBLE AS l, ((n_nationkey - 12) * 5)::DOUBLE AS b FROM nation, range(0, 361, 5) t(l)),
    q AS (SELECT *, radians(122.932::DOUBLE - l) AS df, radians(b) AS br, radians(27.1283::DOUBLE) AS g FROM s),
    t AS (SELECT n_nationkey, l, radians((192.8595::DOUBLE + degrees(atan2(cos(br) * sin(df), sin(br) * cos(g) - cos(br) * sin(g) * cos(df))) + 360) % 360) AS r,
          asin(cos(br) * cos(g) * cos(df) + sin(br) * sin(g)) AS dd, radians(23.4392911::DOUBLE) AS e FROM q)
    SELECT n_nationkey, l AS gal_lon, round((degrees(atan2(sin(r) * cos(e) + tan(dd) * sin(e), cos(r))) + 360) % 360, 3) AS lam, round(degrees(asin(greatest(-1, least(1, sin(dd) * cos(e) - cos(dd) * sin(e) * sin(r))))), 3) AS beta FROM t""",
)
def e10_grid(spark: SparkSession, d: str) -> DataFrame:
    """Galactic latitudes of a table, as lines on the sky."""
    lines = table(spark, d, "nation").select("n_nationkey", ((F.col("n_nationkey") - 12) * 5).cast("double").alias("gal_lat"))
    return K.galactic_lines(lines, 5).select("n_nationkey", "gal_lon", F.round("lam", 3).alias("lam"), F.round("beta", 3).alias("beta"))


#: A palette of our own: Sun altitude, zenith to horizon.
PALETTE = [
    (-18, "#04050f", "#070a1c", "#0b1028", "#101634"),
    (-6, "#12224f", "#1f3670", "#4a4f86", "#a06a78"),
    (0, "#2a4f94", "#5478b4", "#b79a9a", "#f0a45c"),
    (10, "#2f6cc0", "#5a92d6", "#93bce6", "#d4e2ee"),
    (60, "#1c5cc4", "#3f82d8", "#74aae6", "#a8cdf0"),
]
PAL_SCHEMA = "alt int, c0 string, c1 string, c2 string, c3 string"
SEG = f"pal AS (SELECT * FROM {sql_values(PALETTE, 'p', 'alt, c0, c1, c2, c3')}), seg AS (SELECT *, lead(alt) OVER (ORDER BY alt) AS nalt, lead(c3) OVER (ORDER BY alt) AS n3 FROM pal)"


@query(
    "j6_bracket_join",
    f"""WITH {SEG}, o AS (SELECT event_id, value * 0.8 - 30 AS sa, least(60, greatest(-18, value * 0.8 - 30)) AS x FROM events),
    j AS (SELECT event_id, alt, (x - alt) / (nalt - alt) AS t, c3, n3 FROM o JOIN seg ON nalt IS NOT NULL AND (x > alt OR (x = alt AND alt = -18)) AND x <= nalt),
    k AS (SELECT event_id, alt, t, list_transform([2, 4, 6], lambda i: floor(('0x' || substr(c3, i, 2))::INTEGER + (('0x' || substr(n3, i, 2))::INTEGER - ('0x' || substr(c3, i, 2))::INTEGER) * t + 0.5)::INTEGER) AS v FROM j)
    SELECT event_id, alt, round(t, 6) AS t, printf('#%02x%02x%02x', v[1], v[2], v[3]) AS horizon FROM k""",
)
def j6(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "events").select("event_id", (F.col("value") * 0.8 - 30).alias("sa"))
    b = bracket_join(o, values(spark, PALETTE, PAL_SCHEMA), "sa")
    mixed = rgb_to_hex(lerp_rgb(hex_to_rgb(F.col("c3")), hex_to_rgb(F.col("next_c3")), F.col("t")))
    return b.select("event_id", "alt", F.round("t", 6).alias("t"), mixed.alias("horizon"))


def gradient_sql() -> str:
    """The layers one by one over twelve channels."""
    ss = lambda lo, hi, x: (lambda t: f"({t} * {t} * (3 - 2 * {t}))")(f"least(1.0, greatest(0.0, ({x} - {lo}) / ({hi} - {lo})))")
    cap = lambda x: f"greatest(0.0, {x})"
    day, near = ss(-3, 4, "sa"), cap("1 - abs(sa - 1) / 9")
    first = {
        "cover": ss(20, 100, "cl"), "dusk": "CASE WHEN eve THEN 1.0 ELSE 0.0 END", "snow": "CASE WHEN sn > 0 THEN least(0.8, sn / 2) ELSE 0.0 END",
        "middle": f"{ss(30, 100, 'cm')} * 0.35 * {day}", "high": f"{ss(25, 100, 'ch')} * 0.25 * {day}", "humid": f"{ss(65, 100, 'rh')} * 0.30 * {ss(1, 6, 'sa')}",
        "mist": f"{ss(8, 0, '(vis / 1609.34)')} * 0.50 * {day}", "warm0": f"{near} * {cap('1 - abs((cm + ch) / 2 - 55) / 55')} * (1 - {ss(90, 100, 'cl')})",
        "dark0": f"{ss(82, 100, 'cl')} * {cap('1 - abs(sa) / 4')}",
        "glow": f"CASE WHEN eve THEN CASE WHEN sa >= -1 THEN {cap('1 - (sa + 1) / 9')} ELSE {cap('1 + (sa + 1) / 11')} END ELSE 0.0 END",
        "purple": f"CASE WHEN eve THEN {cap('1 - abs(sa + 5) / 5')} ELSE 0.0 END", "violet": f"CASE WHEN eve THEN {cap('1 - abs(sa + 3) / 4')} ELSE 0.0 END", "day": day,
    }
    then = {
        "cloud": f"CASE WHEN sn <= 0 THEN least(0.85, cover * 0.68 + least(1.0, {cap('pr / 1.2')}) * 0.18) * day ELSE 0.0 END",
        "warm": "CASE WHEN warm0 > 0.02 THEN warm0 ELSE 0.0 END", "dark": "CASE WHEN dark0 > 0.02 THEN dark0 ELSE 0.0 END",
    }
    named = lambda cells: ", ".join(f"{x}::DOUBLE AS {n}" for n, x in cells.items())
    lerp = lambda x, y, t: f"floor({x} + ({y} - {x}) * least(1.0, greatest(0.0, {t})) + 0.5)"
    hexed = lambda c, j: f"('0x' || substr({c}, {2 + 2 * j}, 2))::INTEGER"
    rgb = lambda h: [int(h[n : n + 2], 16) for n in (1, 3, 5)]
    base = {f"k{i}{j}": lerp(hexed(f"c{i}", j), hexed(f"n{i}", j), "t") for i in STOPS for j in range(3)}
    steps, last = [], "w2"
    for n, (weight, mix, stops) in enumerate(LAYERS):
        cells = {}
        for i, (share, low, *high) in stops.items():
            for j, a in enumerate(rgb(low)):
                to = lerp(a, rgb(high[0])[j], mix) if high else a
                cells[f"k{i}{j}"] = lerp(f"k{i}{j}", to, f"({weight} * {share!r}::DOUBLE)")
        steps.append(f"l{n} AS (SELECT * REPLACE ({', '.join(f'{x} AS {k}' for k, x in cells.items())}) FROM {last})")
        last = f"l{n}"
    nexts = ", ".join(f"lead(c{i}) OVER (ORDER BY alt) AS n{i}" for i in STOPS)
    return f"""WITH pal AS (SELECT * FROM {sql_values(PALETTE, 'p', 'alt, c0, c1, c2, c3')}), seg AS (SELECT *, lead(alt) OVER (ORDER BY alt) AS nalt, {nexts} FROM pal),
o AS (SELECT event_id, event_id % 2 = 0 AS eve, value * 0.8::DOUBLE - 30 AS sa, (event_id % 101)::DOUBLE AS cl, (event_id * 7 % 101)::DOUBLE AS cm, (event_id * 13 % 101)::DOUBLE AS ch,
  CASE WHEN event_id % 5 > 0 THEN event_id * 3 % 101 ELSE 50 END::DOUBLE AS rh, CASE WHEN event_id % 4 > 0 THEN event_id * 37 % 30000 ELSE 30000 END::DOUBLE AS vis,
  (event_id % 3)::DOUBLE / 2 AS pr, CASE WHEN event_id % 10 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS sn FROM events),
x AS (SELECT *, least(60, greatest(-18, sa)) AS xx FROM o),
w0 AS (SELECT x.*, seg.*, (xx - alt) / (nalt - alt) AS t FROM x JOIN seg ON nalt IS NOT NULL AND (xx > alt OR (xx = alt AND alt = -18)) AND xx <= nalt),
w1 AS (SELECT *, {named(first)} FROM w0), w2 AS (SELECT *, {named(then)}, {named(base)} FROM w1),
{', '.join(steps)}
SELECT event_id, {', '.join(f"printf('#%02x%02x%02x', {', '.join(f'k{i}{j}::INTEGER' for j in range(3))}) AS sky{i}" for i in STOPS)} FROM {last}"""


@query("e11_sky_gradient", gradient_sql())
def e11(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    k = F.col("event_id")
    obs = e.select(
        k, (F.col("value") * 0.8 - 30).alias("sun_alt"), (k % 2 == 0).alias("evening"), (k % 101).alias("cl"), (k * 7 % 101).alias("cm"), (k * 13 % 101).alias("ch"),
        F.when(k % 5 > 0, k * 3 % 101).alias("rh"), F.when(k % 4 > 0, k * 37 % 30_000).alias("vis_m"), (k % 3 / 2).alias("pr"), F.when(k % 10 == 0, 1.0).alias("sn"),
    )
    return sky_gradient(obs, values(spark, PALETTE, PAL_SCHEMA)).select("event_id", "sky0", "sky1", "sky2", "sky3")
