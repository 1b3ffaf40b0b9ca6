"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.sources.literal import small_side


def js_round(x: Column) -> Column:
    """Half up, also below zero: -2.5 gives -2."""
    return F.floor(x + 0.5)


def normalise_elements(df: DataFrame) -> DataFrame:
    """Orbit elements: trimmed name, epoch in UTC milliseconds, rounded elements, launch year or null."""
    angles = {"inclination": "inc", "ra_of_asc_node": "raan", "arg_of_pericenter": "argp", "mean_anomaly": "ma"}
    return df.select(
        F.trim("object_name").alias("name"),
        F.unix_millis(F.to_timestamp("epoch")).alias("epoch_ms"),
        F.round("mean_motion", 8).alias("mean_motion"),
        F.round("eccentricity", 7).alias("ecc"),
        *(F.round(a, 4).alias(b) for a, b in angles.items()),
        F.substring("object_id", 1, 4).try_cast("int").alias("launch_year"),
        "object_id",
    )


def filter_on_orbit(df: DataFrame, decay: str = "decay_date") -> DataFrame:
    return df.where(F.coalesce(decay, F.lit("")) == "")


def filter_prefix_and_type(df: DataFrame, col: str, prefix: str, type_col: str, kind: str) -> DataFrame:
    return df.where(F.col(col).startswith(prefix) & (F.col(type_col) == kind))


def parse_prefixed_id(col: str, prefix: str) -> Column:
    """The digits after the prefix as an int, null where anything else follows."""
    return F.regexp_extract(F.trim(col), f"^{prefix}\\s*([0-9]+)$", 1).try_cast("int")


def tolerant_number(col: str, default: float | None = None) -> Column:
    """A number, or the default (or null) where the text is bad, empty or not a number."""
    n = F.trim(F.col(col).cast("string")).try_cast("double")
    n = F.when(F.isnan(n), None).otherwise(n)
    return n if default is None else F.coalesce(n, F.lit(default))


def precut(df: DataFrame, limit: float, mag: str = "mag") -> DataFrame:
    return df.where(F.col(mag) <= limit)


def filter_depth_ramp(df: DataFrame, lat: str = "beta", mag: str = "mag") -> DataFrame:
    """Deeper magnitudes towards the south: 6.0 from +10 up, 7.5 at -85, nothing below."""
    ramp = F.lit(6.0) + 1.5 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (10 - F.col(lat)) / 95))
    return df.where((F.col(lat) >= -85) & (F.col(mag) <= ramp))


def filter_alerts(df: DataFrame, severities: tuple[str, ...] = ("Severe", "Extreme"), urgencies: tuple[str, ...] = ("Immediate", "Expected")) -> DataFrame:
    return df.where(F.col("severity").isin(*severities) & F.col("urgency").isin(*urgencies))


def admit_requests(df: DataFrame, rules: DataFrame, method: str = "method", url: str = "url") -> DataFrame:
    """Adds host and outcome; the first rule that applies decides.  rules: host, ttl."""
    u = F.coalesce(url, F.lit(""))
    scheme = F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))
    known = small_side(rules, "host").withColumn("known", F.lit(True))
    out = df.withColumns({"host": host, "scheme": scheme}).join(known, "host", "left")
    outcome = (
        F.when(F.col(method) == "OPTIONS", "preflight")
        .when(F.col(method) != "GET", "405")
        .when(u == "", "health")
        .when((F.col("scheme") == "") | (F.col("host") == ""), "400")
        .when(~F.col("scheme").isin("http", "https"), "400")
        .when(F.col("known").isNull(), "403")
        .otherwise("pass")
    )
    return out.withColumn("outcome", outcome).drop("known", "scheme")


def resolve_ttl(override: Column, rule: Column, default: int = 300, most: int = 86_400) -> Column:
    """A positive override up to ``most``, else the rule's, else the default."""
    return F.when(override > 0, F.least(override, F.lit(most))).otherwise(F.coalesce(rule, F.lit(default)))


def scale_linear(x: Column, lo: float, hi: float) -> Column:
    return (x - lo) / (hi - lo) * 100


def temperature_axis(lo: Column, hi: Column) -> tuple[Column, Column]:
    """Axis ends for a temperature range; null for ranges under 50."""
    wide = hi - lo >= 50
    return F.when(wide, F.least(F.lit(-300.0), lo - 20)), F.when(wide, F.greatest(F.lit(900.0), hi + 20))


def layer_thickness(diameter: Column, pct: Column) -> Column:
    return F.when((diameter > 0) & (pct != 0), js_round(diameter / 2 * pct / 100))


def required_source_width(drawn: Column, fr: Column) -> Column:
    return drawn * 2 / (2 * fr)


def grade_coverage(fill: Column) -> Column:
    """Cut-offs chosen here: good from 0.55, small from 0.10."""
    return F.when(fill >= 0.55, "good").when(fill >= 0.10, "small").when(fill.isNotNull(), "barely resolved")


def storm_tier(knots: Column) -> Column:
    """Saffir-Simpson, in knots."""
    return (
        F.when(knots >= 137, "C5").when(knots >= 113, "C4").when(knots >= 96, "C3").when(knots >= 83, "C2").when(knots >= 64, "C1").when(knots >= 34, "TS").when(knots.isNotNull(), "TD")
    )


def probability_tier(pct: Column) -> Column:
    """Cut-offs chosen here: low under 40, medium to 60."""
    return F.when(pct > 60, "high").when(pct >= 40, "medium").when(pct.isNotNull(), "low")
