"""Positions of Sun, Moon and planets for whole tables of instants, in column arithmetic.

Angles are degrees unless a name says otherwise.  Orbital elements are the published ones for days counted from
JD 2451543.5.  Newton's method for Kepler's equation runs as ten staged columns, so that no expression nests.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators.joins import observation_grid
from skyloom.sources.literal import literal_table

#: Node, inclination, perihelion, axis, eccentricity, anomaly, each at the epoch and per day.
ELEMENTS = {
    "mercury": (48.3313, 3.24587e-5, 7.0047, 5.00e-8, 29.1241, 1.01444e-5, 0.387098, 0.0, 0.205635, 5.59e-10, 168.6562, 4.0923344368),
    "venus": (76.6799, 2.46590e-5, 3.3946, 2.75e-8, 54.8910, 1.38374e-5, 0.723330, 0.0, 0.006773, -1.302e-9, 48.0052, 1.6021302244),
    "mars": (49.5574, 2.11081e-5, 1.8497, -1.78e-8, 286.5016, 2.92961e-5, 1.523688, 0.0, 0.093405, 2.516e-9, 18.6021, 0.5240207766),
    "jupiter": (100.4542, 2.76854e-5, 1.3030, -1.557e-7, 273.8777, 1.64505e-5, 5.20256, 0.0, 0.048498, 4.469e-9, 19.8950, 0.0830853001),
    "saturn": (113.6634, 2.38980e-5, 2.4886, -1.081e-7, 339.3939, 2.97661e-5, 9.55475, 0.0, 0.055546, -9.499e-9, 316.9670, 0.0334442282),
    "uranus": (74.0005, 1.3978e-5, 0.7733, 1.9e-8, 96.6612, 3.0565e-5, 19.18171, -1.55e-8, 0.047318, 7.45e-9, 142.5905, 0.011725806),
    "neptune": (131.7806, 3.0173e-5, 1.7700, -2.55e-7, 272.8461, -6.027e-6, 30.05826, 3.313e-8, 0.008606, 2.15e-9, 260.2471, 0.005995147),
}
SUN = (0.0, 0.0, 0.0, 0.0, 282.9404, 4.70935e-5, 1.0, 0.0, 0.016709, -1.151e-9, 356.0470, 0.9856002585)
MOON = (125.1228, -0.0529538083, 5.1454, 0.0, 318.0634, 0.1643573223, 60.2666, 0.0, 0.054900, 0.0, 115.3654, 13.0649929509)
NAMES = ("node", "incl", "peri", "axis", "ecc", "anom")
NEWTON_STEPS = 10
#: Perturbations of the Moon as (degrees, multiples of D, Mm, Ms, F).
MOON_LON = [
    (-1.274, -2, 1, 0, 0), (0.658, 2, 0, 0, 0), (-0.186, 0, 0, 1, 0), (-0.059, -2, 2, 0, 0), (-0.057, -2, 1, 1, 0), (0.053, 2, 1, 0, 0),
    (0.046, 2, 0, -1, 0), (0.041, 0, 1, -1, 0), (-0.035, 1, 0, 0, 0), (-0.031, 0, 1, 1, 0), (-0.015, -2, 0, 0, 2), (0.011, -4, 1, 0, 0),
]
MOON_LAT = [(-0.173, -2, 0, 0, 1), (-0.055, -2, 1, 0, -1), (-0.046, -2, 1, 0, 1), (0.033, 2, 0, 0, 1), (0.017, 0, 2, 0, 1)]
MOON_RADII = [(-0.58, -2, 1, 0, 0), (-0.46, 2, 0, 0, 0)]
#: Kilometres, multiples of D and of Mm, of the Moon's distance; and its mean value.
MOON_KM = [(-20905.355, 0, 1), (-3699.111, 2, -1), (-2955.968, 2, 0), (-569.925, 0, 2), (246.158, 2, -2)]
MEAN_KM = 385000.56


def wrap(x: Column) -> Column:
    return F.pmod(x, F.lit(360.0))


def sin_d(x: Column) -> Column:
    return F.sin(F.radians(x))


def cos_d(x: Column) -> Column:
    return F.cos(F.radians(x))


def with_julian_day(df: DataFrame, ts: str) -> DataFrame:
    """jd and d = jd - 2451545.0, to the second."""
    jd = F.unix_seconds(F.col(ts).cast("timestamp")) / 86_400.0 + 2_440_587.5
    return df.withColumn("jd", jd).withColumn("d", jd - 2_451_545.0)


def elements_table(spark: SparkSession, bodies: dict[str, tuple] | None = None) -> DataFrame:
    cols = ", ".join(f"{n}0 double, {n}1 double" for n in NAMES)
    return literal_table(spark, [(b, *map(float, e)) for b, e in (bodies or ELEMENTS).items()], f"body string, {cols}")


def solve_orbit(df: DataFrame, prefix: str = "") -> DataFrame:
    """From n0, n1, ... and d: x, y, z and r in the ecliptic, and vlon = argument of latitude."""
    day = F.col("d") + 1.5
    df = df.withColumns({n: F.col(f"{n}0") + F.col(f"{n}1") * day for n in NAMES})
    df = df.withColumn("anom", F.radians(wrap(F.col("anom")))).withColumn("ecc_anom", F.col("anom") + F.col("ecc") * F.sin("anom"))
    for _ in range(NEWTON_STEPS):
        step = (F.col("ecc_anom") - F.col("ecc") * F.sin("ecc_anom") - F.col("anom")) / (1 - F.col("ecc") * F.cos("ecc_anom"))
        df = df.withColumn("ecc_anom", F.col("ecc_anom") - step)
    df = df.withColumn("xv", F.col("axis") * (F.cos("ecc_anom") - F.col("ecc"))).withColumn("yv", F.col("axis") * F.sqrt(1 - F.col("ecc") * F.col("ecc")) * F.sin("ecc_anom"))
    df = df.withColumn("r", F.sqrt(F.col("xv") * F.col("xv") + F.col("yv") * F.col("yv"))).withColumn("vlon", F.degrees(F.atan2("yv", "xv")) + F.col("peri"))
    v, n, i = F.col("vlon"), F.col("node"), F.col("incl")
    df = df.withColumns(
        {
            f"{prefix}x": F.col("r") * (cos_d(n) * cos_d(v) - sin_d(n) * sin_d(v) * cos_d(i)),
            f"{prefix}y": F.col("r") * (sin_d(n) * cos_d(v) + cos_d(n) * sin_d(v) * cos_d(i)),
            f"{prefix}z": F.col("r") * sin_d(v) * sin_d(i),
            f"{prefix}r": F.col("r"),
        }
    )
    drop = [*NAMES, *(f"{n}{k}" for n in NAMES for k in "01"), "ecc_anom", "xv", "yv", "vlon"]
    return df.drop(*drop, *(["r"] if prefix else []))


def with_elements(df: DataFrame, e: tuple) -> DataFrame:
    return df.withColumns({f"{n}{k}": F.lit(float(e[2 * j + k])) for j, n in enumerate(NAMES) for k in (0, 1)})


def heliocentric_positions(bodies: DataFrame, instants: DataFrame) -> DataFrame:
    """x, y, z, r of every body (a table of elements, few rows) at every instant (with d)."""
    return solve_orbit(observation_grid(instants, bodies))


def sun_positions(instants: DataFrame) -> DataFrame:
    """Geocentric Sun: sx, sy, sz, sr and sun_lon."""
    return solve_orbit(with_elements(instants, SUN), "s").withColumn("sun_lon", wrap(F.degrees(F.atan2("sy", "sx"))))


def moon_positions(instants: DataFrame) -> DataFrame:
    """moon_lon, moon_lat (with perturbations), moon_radii (Earth radii) and moon_km."""
    df = solve_orbit(with_elements(instants, MOON), "m")
    day = F.col("d") + 1.5
    at = lambda e, j: F.lit(e[2 * j]) + F.lit(e[2 * j + 1]) * day
    ms, mm = at(SUN, 5), at(MOON, 5)
    mean = at(MOON, 0) + at(MOON, 2) + mm
    df = df.withColumns({"a_d": wrap(mean - (ms + at(SUN, 2))), "a_mm": wrap(mm), "a_ms": wrap(ms), "a_f": wrap(mean - at(MOON, 0))})

    def series(terms: list[tuple], f) -> Column:
        total = F.lit(0.0)
        for amp, *k in terms:
            total = total + amp * f(sum((F.col(n) * m for n, m in zip(("a_d", "a_mm", "a_ms", "a_f"), k, strict=True) if m), F.lit(0.0)))
        return total

    lon = F.degrees(F.atan2("my", "mx")) + series(MOON_LON, sin_d)
    lat = F.degrees(F.atan2(F.col("mz"), F.sqrt(F.col("mx") * F.col("mx") + F.col("my") * F.col("my")))) + series(MOON_LAT, sin_d)
    mp, dd = 134.9633964 + 13.06499295 * F.col("d"), 297.8501921 + 12.19074912 * F.col("d")
    km = F.lit(MEAN_KM)
    for amp, k, m in MOON_KM:
        km = km + amp * cos_d(dd * k + mp * m)
    df = df.withColumns({"moon_lon": wrap(lon), "moon_lat": lat, "moon_radii": F.col("mr") + series(MOON_RADII, cos_d), "moon_km": km})
    return df.drop("mx", "my", "mz", "mr", "a_d", "a_mm", "a_ms", "a_f")


def to_equatorial(df: DataFrame, x: Column, y: Column, z: Column, names: tuple[str, str] = ("ra", "dec")) -> DataFrame:
    """Ecliptic vector to right ascension [0, 2 pi) and declination, in radians."""
    eps = F.radians(23.4393 - 3.563e-7 * F.col("d"))
    df = df.withColumns({"_x": x, "_y": y * F.cos(eps) - z * F.sin(eps), "_z": y * F.sin(eps) + z * F.cos(eps)})
    ra = F.pmod(F.atan2("_y", "_x"), F.lit(2 * pi))
    dec = F.atan2(F.col("_z"), F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y")))
    return df.withColumns(dict(zip(names, (ra, dec), strict=True))).drop("_x", "_y", "_z")


def apparent_positions(bodies: DataFrame, instants: DataFrame) -> DataFrame:
    """ra and dec of the bodies as seen from Earth, sun_ra and sun_dec beside them, all in radians."""
    df = heliocentric_positions(bodies, sun_positions(instants))
    df = to_equatorial(df, F.col("x") + F.col("sx"), F.col("y") + F.col("sy"), F.col("z") + F.col("sz"))
    return to_equatorial(df, F.col("sx"), F.col("sy"), F.col("sz"), ("sun_ra", "sun_dec"))


def sidereal_degrees(d: Column) -> Column:
    t = d / 36_525.0
    return wrap(280.46061837 + 360.98564736629 * d + 0.000387933 * t * t - t * t * t / 38_710_000.0)


def horizon_positions(df: DataFrame, suffix: str = "", day: Column | None = None) -> DataFrame:
    """alt and az (degrees) of ra, dec for observers lat, lon."""
    d = F.col("d") if day is None else day
    h = F.radians(wrap(sidereal_degrees(d) + F.col("lon"))) - F.col("ra")
    df = df.withColumn("_h", h)
    lat = F.radians("lat")
    alt = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin("dec") * F.sin(lat) + F.cos("dec") * F.cos(lat) * F.cos("_h"))))
    df = df.withColumn("_alt", alt)
    cos_az = (F.sin("dec") - F.sin("_alt") * F.sin(lat)) / (F.cos("_alt") * F.cos(lat))
    az = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos_az))))
    return df.withColumns({f"alt{suffix}": F.degrees("_alt"), f"az{suffix}": F.when(F.sin("_h") > 0, 360 - az).otherwise(az)}).drop("_h", "_alt")


WINDS = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]


def trend(df: DataFrame, minutes: int = 30) -> DataFrame:
    """'rising' where the altitude some minutes on is greater."""
    later = horizon_positions(df, "_later", F.col("d") + minutes / 1440)
    return later.withColumn("trend", F.when(F.col("alt_later") > F.col("alt"), "rising").otherwise("setting")).drop("alt_later", "az_later")


def observing_report(positions: DataFrame, observers: DataFrame) -> DataFrame:
    """Altitude, azimuth, direction, quality, trend and true elongation from the Sun of every body for every observer."""
    df = trend(horizon_positions(observation_grid(positions, observers)))
    alt, az = F.floor(F.col("alt") + 0.5).cast("int"), F.floor(F.col("az") + 0.5).cast("int")
    df = df.withColumns({"alt_deg": alt, "az_deg": az})
    a = F.col("alt_deg")
    wind = F.element_at(F.array(*map(F.lit, WINDS)), (F.floor(F.col("az_deg") / 22.5 + 0.5) % 16 + 1).cast("int"))
    quality = F.when(a > 30, "Excellent").when(a > 20, "Good").when(a > 10, "Fair").when(a > 0, "Low").otherwise("Below horizon")
    cos_sep = F.sin("dec") * F.sin("sun_dec") + F.cos("dec") * F.cos("sun_dec") * F.cos(F.col("ra") - F.col("sun_ra"))
    sep = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos_sep))))
    return df.withColumns({"direction": wind, "quality": quality, "elongation": sep})


PHASES = [(10, "New Moon"), (85, "Waxing Crescent"), (95, "First Quarter"), (175, "Waxing Gibbous"), (185, "Full Moon"), (265, "Waning Gibbous"), (275, "Last Quarter"), (350.000001, "Waning Crescent")]


def ladder(x: Column, steps: list[tuple[float, object]], last: object, closed: bool = False) -> Column:
    out = None
    for limit, label in steps:
        test = x <= limit if closed else x < limit
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out.otherwise(F.lit(last))


def moon_phase_calendar(instants: DataFrame) -> DataFrame:
    """Phase angle, name, illumination, days to the next full and new Moon, impact and terminator steps, distance."""
    df = moon_positions(sun_positions(instants)).withColumn("angle", wrap(F.col("moon_lon") - F.col("sun_lon")))
    a = F.col("angle")
    df = df.withColumns(
        {
            "phase": ladder(a, PHASES, "New Moon"),
            "illum": F.floor((1 - cos_d(a)) / 2 * 100 + 0.5).cast("int"),
            "waxing": a < 180,
            "to_full": F.floor(F.pmod(180 - a + 360, F.lit(360.0)) / 12.19 + 0.5).cast("int"),
            "to_new": F.floor(F.pmod(360 - a, F.lit(360.0)) / 12.19 + 0.5).cast("int"),
        }
    )
    df = df.withColumns({c: F.when(F.col(c) > 29, 0).otherwise(F.col(c)) for c in ("to_full", "to_new")})
    impact = ladder(F.col("illum"), [(10, 0), (30, 1), (60, 2), (85, 3), (96, 4)], 5)
    day = F.floor(F.floor(a + 0.5) / 12.2 + 0.5)
    steps = ladder(day, [(v, i) for i, v in enumerate((3, 6, 9, 12, 15, 18, 22, 26))], 8, closed=True)
    return df.withColumns({"impact": impact, "terminator": steps})


def equatorial_to_ecliptic(df: DataFrame, ra: str, dec: str, obliquity: float = 23.4392911) -> DataFrame:
    """lambda [0, 360) and beta, in degrees."""
    e = F.radians(F.lit(obliquity))
    r, d = F.radians(ra), F.radians(dec)
    sb = F.sin(d) * F.cos(e) - F.cos(d) * F.sin(e) * F.sin(r)
    lam = wrap(F.degrees(F.atan2(F.sin(r) * F.cos(e) + F.tan(d) * F.sin(e), F.cos(r))))
    return df.withColumns({"lam": lam, "beta": F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sb))))})


def galactic_to_equatorial(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """By the IAU pole: right ascension 192.8595, declination 27.1283, node longitude 122.932."""
    a, g, n = 192.8595, F.radians(F.lit(27.1283)), 122.932
    diff, b = F.radians(F.lit(n) - F.col(lon)), F.radians(lat)
    s = F.cos(b) * F.cos(g) * F.cos(diff) + F.sin(b) * F.sin(g)
    y, x = F.cos(b) * F.sin(diff), F.sin(b) * F.cos(g) - F.cos(b) * F.sin(g) * F.cos(diff)
    return df.withColumns({"ra": wrap(F.lit(a) + F.degrees(F.atan2(y, x))), "dec": F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s))))})


def galactic_lines(lines: DataFrame, step: int, lat: str = "gal_lat") -> DataFrame:
    """Ecliptic places of lines of galactic latitude, every ``step`` degrees of longitude of each."""
    along = lines.withColumn("gal_lon", F.explode(F.sequence(F.lit(0), F.lit(360), F.lit(step)))).withColumn("gal_lon", F.col("gal_lon").cast("double"))
    return equatorial_to_ecliptic(galactic_to_equatorial(along, "gal_lon", lat), "ra", "dec")


def galactic_grid(spark: SparkSession, step: int, lat: float) -> DataFrame:
    """One such line."""
    return galactic_lines(literal_table(spark, [(float(lat),)], "gal_lat double"), step)
