"""Aggregations, windows, order and set operations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyloom.operators.components import TILE, cell_components
from skyloom.operators.scans import prefix_scan
from skyloom.sources.shared import discard, saved


def totals_by_group(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("total"))


count_by_type: Callable[[DataFrame, str], DataFrame] = totals_by_group


def ever_vs_current(df: DataFrame, event: str, current: str) -> DataFrame:
    return df.groupBy(event).agg(F.count("*").alias("ever"), F.count_if(current).alias("up"))


def ledger_summary(df: DataFrame, type_col: str, kinds: list[str], per_event: DataFrame) -> DataFrame:
    """One row: total, a count per chosen type, and a map event -> (ever, up)."""
    totals = df.agg(F.count("*").alias("on_orbit"), *(F.count_if(F.col(type_col) == k).alias(f"n_{i}") for i, k in enumerate(kinds)))
    events = per_event.agg(F.map_from_entries(F.collect_list(F.struct("event_key", F.struct("ever", "up")))).alias("events"))
    return totals.crossJoin(events)


def groups_having_mean(df: DataFrame, group: str, value: str, over: float) -> DataFrame:
    keep = df.groupBy(group).agg(F.avg(value).alias("_m")).where(F.col("_m") > over).select(group)
    return df.join(keep, group, "left_semi")


def collect_ordered_nested(df: DataFrame, ident: str, seg: str, pos: str, values: list[str]) -> DataFrame:
    """id -> segments -> points, both in order.  Rows are dealt by id once, for both groupings."""
    points = df.repartition(ident).groupBy(ident, seg).agg(F.array_sort(F.collect_list(F.struct(pos, *values))).alias("p"))
    lines = points.groupBy(ident).agg(F.array_sort(F.collect_list(F.struct(seg, "p"))).alias("s"))
    return lines.select(ident, F.transform("s", lambda s: F.transform(s["p"], lambda p: F.array(*(p[v] for v in values)))).alias("lines"))


def require_rows(df: DataFrame, least: int) -> DataFrame:
    """The table saved, or an error if it has fewer rows: a gate ahead of a sink.  Rows are counted as they are written, so
    the plan runs once.  (A sink of generations has a gate of its own.)"""
    seen = Observation()
    out = saved(df.observe(seen, F.count(F.lit(1)).alias("rows")), "gated")
    found = seen.get["rows"]
    if found < least:
        discard(out)
        raise ValueError(f"{found} rows; {least} are needed")
    return out


def dedupe_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.groupBy(key).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_r")).select("_r.*")


def savings_summary(df: DataFrame, before: str, after: str) -> DataFrame:
    out = df.agg(F.sum(before).alias("before"), F.sum(after).alias("after"))
    return out.withColumn("saved_pct", F.round((1 - F.col("after") / F.col("before")) * 100, 2))


def running_ranges(df: DataFrame, group: str, order: str, pct: str) -> DataFrame:
    out = prefix_scan(df, [group], [order], {"end": ("sum", pct)})
    return out.withColumn("start", F.col("end") - F.col(pct))


def systematic_sample(df: DataFrame, group: str, order: str, caps: DataFrame) -> DataFrame:
    """Groups over their cap keep the rows at floor(i * n / cap), i < cap; others keep all.  caps: group, cap.

    Rows are numbered in slices of the (group, order) range and by the counts of the slices before, so a large group
    is many tasks' work.  The slices are saved, as a range is drawn anew whenever it is computed.
    """
    sliced = saved(df.repartitionByRange(group, order).withColumn("_slice", F.spark_partition_id()), "slices")
    counts = sliced.groupBy(F.col(group).alias("_g"), F.col("_slice").alias("_s")).agg(F.count("*").alias("_c"))
    of_group = Window.partitionBy("_g")
    before = F.sum("_c").over(of_group.orderBy("_s")) - F.col("_c")
    starts = counts.select("_g", "_s", before.alias("_first"), F.sum("_c").over(of_group).alias("_n"))  # groups + slices rows at most
    rows = sliced.withColumn("_i", F.row_number().over(Window.partitionBy("_slice", group).orderBy(order)) - 1)
    rows = rows.join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_slice") == F.col("_s"))).withColumn("_i", F.col("_i") + F.col("_first"))
    rows = rows.join(caps, group, "left")
    step = F.col("_n") / F.col("cap")
    # Row i is kept if some k has floor(k * step) = i: the first k with k * step >= i is the one to try, and the ones beside.
    k = F.ceil(F.col("_i") / step)
    hit = lambda c: (c >= 0) & (c < F.col("cap")) & (F.floor(c * step) == F.col("_i"))
    kept = F.col("cap").isNull() | (F.col("_n") <= F.col("cap")) | hit(k - 1) | hit(k) | hit(k + 1)
    return rows.where(kept).select(*df.columns)


def pick_largest(df: DataFrame, group: str, order: list) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def brightest_first(df: DataFrame, mag: str, tie: list[str], n: int | None = None) -> DataFrame:
    out = df.orderBy(F.round(mag, 1), *tie)
    return out if n is None else out.limit(n)


def sort_by_key(df: DataFrame, key: str) -> DataFrame:
    return df.orderBy(key)


def shuffle_rows(df: DataFrame, key: str, seed: int) -> DataFrame:
    """A permutation that the seed decides: by the md5 of seed and key, alike in every engine."""
    return df.orderBy(shuffle_key(key, seed), key)


def shuffle_key(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))


def union_groups(tables: dict[str, DataFrame]) -> DataFrame:
    """All tables as one, tagged by name and by place."""
    out = None
    for i, (name, df) in enumerate(tables.items()):
        df = df.withColumns({"group": F.lit(name), "group_pos": F.lit(i)})
        out = df if out is None else out.unionByName(df)
    return out


def components_of_cells(cells: DataFrame, threshold: int, link: Callable[[DataFrame], DataFrame], side: int = TILE) -> DataFrame:
    """4-neighbour components of the cells brighter than the threshold: image_id, x, y, lum, comp (smallest cell number).

    ``link`` finds the components of (a, b) links.  Cells are numbered by (y, x) within 2^20 columns; those without a place
    are none.
    """
    on = cells.where((F.col("lum") > threshold) & F.col("x").isNotNull() & F.col("y").isNotNull())
    return cell_components(on.withColumn("cell", F.col("y").cast("long") * (1 << 20) + F.col("x")), link, side)


def component_bbox(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("image_id", "comp").agg(
        F.count("*").alias("area"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"),
        F.min(F.struct("y", "x")).alias("seed"),
    )
