"""Joins.  Rules, palettes and calendars are broadcast once they were counted to be small; larger ones are met by equal keys,
by cells or in a common order, never row by row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyloom.operators.scans import asof_join, prefix_scan
from skyloom.sources.literal import fits, small_side
from skyloom.sources.shared import needs, saved

#: Breakpoints up to so many are compared with every row.
FEW = 64
#: Parts into which dimensions too large to be broadcast are dealt.
CELLS = 64
#: Subscribers of a block, as many as Parquet packs in a run; alerts of a cell, about; rows of a task's result, about; rows that a
#: task sends to blocks, about.
BLOCK, CELL_ALERTS, TASK_ROWS, SENT_ROWS = 504, 16_384, 1 << 25, 1 << 21


def join_catalogue(ident: DataFrame, basic: DataFrame, fluxes: DataFrame, key: str, like: str, name: str) -> DataFrame:
    return ident.where(F.col(name).like(like)).join(basic, key).join(fluxes, key, "left")


def lookup(df: DataFrame, dim: DataFrame, key: str, value: str, default: object = None) -> DataFrame:
    """Value of a small dimension, or the default."""
    out = df.join(small_side(dim, key, value), key, "left")
    return out if default is None else out.withColumn(value, F.coalesce(value, F.lit(default)))


def allowlist(df: DataFrame, rules: DataFrame, key: str = "host") -> DataFrame:
    return df.join(small_side(rules, key), key, "left_semi")


def rejected(df: DataFrame, rules: DataFrame, key: str = "host") -> DataFrame:
    return df.join(small_side(rules, key), key, "left_anti")


def append_missing(base: DataFrame, extra: DataFrame, key: str, order: str) -> DataFrame:
    """Base rows, and of the extra rows the first of each trimmed key that base lacks."""
    k = F.trim(F.col(key))
    first = extra.withColumn("_k", k).withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy(order))).where("_n = 1")
    missing = first.join(base.select(k.alias("_k")).distinct(), "_k", "left_anti").drop("_k", "_n")
    return base.withColumn("appended", F.lit(False)).unionByName(missing.withColumn("appended", F.lit(True)))


def prefix_event_join(ledger: DataFrame, events: DataFrame, ident: str, length: int = 8) -> DataFrame:
    """events: event_key, prefix, all of one length, so that an equality does."""
    return ledger.withColumn("prefix", F.substring(ident, 1, length)).join(events, "prefix")


def segments(breakpoints: DataFrame, key: str = "alt", by: tuple[str, ...] = ()) -> DataFrame:
    """Consecutive breakpoints as rows: each row and, as next_*, the following one; the last row has none."""
    w = Window.partitionBy(*by).orderBy(key) if by else Window.partitionBy(F.lit(0)).orderBy(key)
    return breakpoints.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in breakpoints.columns if c not in by))


def brackets(breakpoints: DataFrame, key: str) -> DataFrame:
    """``segments`` of a table of any size, without the last breakpoint's."""
    seen = prefix_scan(breakpoints, [], [key], {"_from": ("last", F.struct(*breakpoints.columns))}, inclusive=False).where("_from IS NOT NULL")
    return seen.select("_from.*", *(F.col(c).alias(f"next_{c}") for c in breakpoints.columns))


def bracket_join(obs: DataFrame, breakpoints: DataFrame, x: str, key: str = "alt", few: int = FEW) -> DataFrame:
    """Each observation with the segment around its clamped x, and t in [0, 1] along it.  A breakpoint belongs to the
    segment that ends there, but for the first.  A palette is broadcast; more than ``few`` breakpoints and the
    observations are sorted as one table.  Breakpoints are distinct; fewer than two have no segments."""
    ends = breakpoints.agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
    low, high = F.lit(ends["low"]), F.lit(ends["high"])
    df = obs.withColumn("_x", F.greatest(low, F.least(high, F.col(x))))
    if fits(breakpoints, few):
        seg = F.broadcast(segments(breakpoints, key).where(f"next_{key} IS NOT NULL"))
        inside = ((F.col("_x") > F.col(key)) | ((F.col("_x") == F.col(key)) & (F.col(key) == low))) & (F.col("_x") <= F.col(f"next_{key}"))
        out = df.join(seg, inside)
    else:
        first = F.when(F.col(key) != low, F.col(key))  # the first segment has its own start too, so it begins before all
        out = asof_join(df, brackets(breakpoints, key), "_x", first, strict=True).where(F.col(key).isNotNull())
    return out.withColumn("t", (F.col("_x") - F.col(key)) / (F.col(f"next_{key}") - F.col(key))).drop("_x")


def event_proximity(days: Column) -> Column:
    """In the next half year, today, or within the last 30 days."""
    return F.when(days == 0, "today").when((days > 0) & (days < 180), F.concat(F.lit("in "), days.cast("string"), F.lit(" days"))).when((days < 0) & (days >= -30), "recently")


def event_proximity_join(now: DataFrame, events: DataFrame, key: str, now_ts: str, event_ts: str) -> DataFrame:
    """The nearest event of each row's key from 30 days back to 180 ahead.

    Rows and events meet by key and 30-day cell of the row's time; an event stands in the cells that it can be near to.
    """
    days = F.floor((F.unix_seconds(event_ts) - F.unix_seconds(now_ts)) / 86_400 + 0.5)
    cell = lambda ts, shift: F.floor((F.unix_seconds(ts) + shift * 86_400) / (30 * 86_400))
    there = events.withColumn("_cell", F.explode(F.sequence(cell(event_ts, -180), cell(event_ts, 31))))
    near = now.withColumn("_cell", cell(now_ts, 0)).join(there, [key, "_cell"]).withColumn("days", days).where("days >= -30 AND days < 180")
    best = near.groupBy(*now.columns).agg(F.min_by("days", F.struct(F.abs("days"), -F.col("days"))).alias("days"))
    return best.withColumn("proximity", event_proximity(F.col("days")))


def calendar_window_join(df: DataFrame, windows: DataFrame, ts: str) -> DataFrame:
    """Rows within month-day windows (md_start, md_end), which may go over the year's end.

    A window stands once for every day of the year that it holds, so rows meet it by equality.
    """
    days = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: F.transform(F.sequence(F.lit(1), F.lit(31)), lambda d: m * 100 + d)))
    start, end = F.col("md_start"), F.col("md_end")
    held = F.filter(days, lambda md: F.when(start <= end, md.between(start, end)).otherwise((md >= start) | (md <= end)))
    cells = windows.withColumn("_md", F.explode(held))
    cells = F.broadcast(cells) if fits(windows, 1_000) else cells  # 372 days a window at most
    return df.withColumn("_md", F.month(ts) * 100 + F.dayofmonth(ts)).join(cells, "_md").drop("_md")


def observation_grid(positions: DataFrame, *dimensions: DataFrame) -> DataFrame:
    """Every row of positions for every row of each dimension: bodies, observers.

    A dimension that was counted to be small is broadcast.  A larger one is dealt into cells, and every row of positions
    goes to each of them.
    """
    for dim in dimensions:
        if fits(dim):
            positions = positions.crossJoin(F.broadcast(dim))
        else:
            cells = dim.withColumn("_cell", F.pmod(F.xxhash64(*dim.columns), F.lit(CELLS)).cast("int"))
            positions = positions.withColumn("_cell", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1)))).join(cells, "_cell").drop("_cell")
    return positions


def fan_out(alerts: DataFrame, subs: DataFrame, place: list[str]) -> DataFrame:
    """Alerts are matched once per distinct place, then expanded to its subscribers.

    The result is a row for every alert and subscriber of a place.  Subscribers are dealt into blocks, alerts into cells, and
    every cell meets every block of its place, so a hot place is many tasks' work.  What is shuffled is a BLOCK-th of the
    result, sent by many tasks however the alerts are stored.  Its rows stand block by block and alert by alert, so that the
    same subscribers come again after a few rows and files of the result stay small.
    """
    count = lambda df, name: df.groupBy(*place).agg(F.count("*").alias(name))
    parts = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    places = count(alerts, "_alerts").join(count(subs, "_subs"), place).withColumns({"_cells": parts("_alerts", CELL_ALERTS), "_groups": parts("_subs", 16 * BLOCK)})
    places = places.withColumns({"_blocks": F.ceil(F.col("_subs") / (F.col("_groups") * BLOCK)).cast("int"), "_place": F.monotonically_increasing_id()})
    places = saved(places, "places")
    total = lambda n: F.sum(F.col("_alerts").cast("double") * n)
    rows, sent = (n or 0 for n in places.agg(total(F.col("_subs")), total(F.col("_groups") * F.col("_blocks"))).first())
    tasks, senders = (max(alerts.sparkSession.sparkContext.defaultParallelism, math.ceil(n / size)) for n, size in ((rows, TASK_ROWS), (sent, SENT_ROWS)))

    known = small_side(places, *place, "_place", "_cells", "_groups", "_blocks")
    plain = lambda df: [F.to_json(F.struct(c)) if "map<" in kind else F.col(c) for c, kind in df.dtypes]  # noqa: E731  maps have no order
    dealt = lambda df, n: F.pmod(F.xxhash64(*plain(df)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    # Alerts are dealt evenly before they are multiplied: a file of one row group would be one task's work.
    cells = alerts.join(known, place).withColumn("_cell", dealt(alerts, "_cells")).repartition(senders)
    cells = cells.withColumn("_block", every(F.col("_groups") * F.col("_blocks")))
    # Blocks are full, so a group's rows are numbered; what a group has beyond its blocks begins with the first again.
    grouped = subs.join(known, place).withColumn("_group", dealt(subs, "_groups"))
    number = F.row_number().over(Window.partitionBy("_place", "_group").orderBy(*plain(subs))) - 1
    blocks = grouped.withColumn("_block", F.col("_group") * F.col("_blocks") + F.floor(number / BLOCK).cast("int") % F.col("_blocks")).withColumn("_cell", every(F.col("_cells")))

    # Merged, as that keeps the order; dealt by number, as the result is far larger than what is shuffled.
    keys, rest = ["_place", "_cell", "_block"], lambda df: [c for c in df.columns if c not in place]
    cells = cells.select(*keys, *place, *rest(alerts)).repartition(tasks, *keys)
    blocks = blocks.select(*keys, *rest(subs)).repartition(tasks, *keys)
    return needs(cells.join(blocks.hint("merge"), keys).drop(*keys), places)


def drift_check(old: DataFrame, new: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """Both generations side by side: drift, and whether it is within tolerance; a missing side is not."""
    both = old.select(key, F.col(value).alias("old")).join(new.select(key, F.col(value).alias("new")), key, "full")
    drift = F.abs(F.col("old") - F.col("new"))
    return both.withColumn("drift", drift).withColumn("ok", F.coalesce(drift <= tolerance, F.lit(False)))


def licence_gate(images: DataFrame, policy: DataFrame, key: str = "source") -> DataFrame:
    """Images with their licence; share-alike ones are rejected where derivatives are made of them."""
    out = images.join(small_side(policy), key, "left")
    return out.withColumn("accepted", F.coalesce(~(F.col("share_alike") & F.col("derived")), F.lit(False)))
