"""Running values over slices of an order, so that one large group is many tasks' work; and joins to the last row before.

A table is cut into ranges of (group, order), the slices.  Within a slice a window gives running values; what groups that
go over several slices carry into each is folded over the slices' own totals, two rows a slice at most, and added.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyloom.sources.shared import needs, saved

FOLDS = {
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "count": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda before, here: F.coalesce(here, before)),
}


def prefix_scan(df: DataFrame, group: list[str], order: list[str | Column], carries: Mapping[str, tuple[str, str | Column]], *, inclusive: bool = True, slices: int | None = None) -> DataFrame:
    """Adds a running value for each of ``carries`` (name: (fold, column)) over each group in order.

    Folds: sum, count (of non-nulls), max, min and last (non-null value).  Without ``inclusive`` a row's own value is left
    out.  Nulls sort first, as groups they are one.  Of rows that tie in the order any may come first.  An order by a
    descending column is an order by its negative.
    """
    slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    orders = {f"_o{i}": as_col(c) for i, c in enumerate(order)}
    values = {f"_v{i}": F.when(as_col(c).isNotNull(), F.lit(1)).cast("long") if fold == "count" else as_col(c) for i, (fold, c) in enumerate(carries.values())}
    # Saved, as a range is drawn anew whenever it is computed.
    cut = df.withColumns(orders | values).repartitionByRange(slices, *group, *orders).withColumn("_slice", F.spark_partition_id())
    cut = saved(cut, "slices")

    place = F.struct(*orders)
    totals, across, here, joined = [], [], {}, {}
    within = Window.partitionBy("_slice", *group).orderBy(*orders).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    earlier = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    for i, (name, (fold, _)) in enumerate(carries.items()):
        over, add = FOLDS[fold]
        v = F.col(f"_v{i}")
        totals.append((F.max_by(v, F.when(v.isNotNull(), place)) if fold == "last" else over(v)).alias(f"_t{i}"))
        across.append(over(F.col(f"_t{i}")).over(earlier).alias(f"_c{i}"))
        here[f"_h{i}"] = over(v).over(within)
        joined[name] = F.coalesce(add(F.col(f"_c{i}"), F.col(f"_h{i}")), F.lit(0)) if fold == "count" else add(F.col(f"_c{i}"), F.col(f"_h{i}"))
    ends = cut.groupBy("_slice", *group).agg(*totals)
    after_first = F.lag(F.lit(1)).over((Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy("_slice"))
    carried = ends.select(F.col("_slice").alias("_s"), *(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), *across, after_first.alias("_more")).where("_more = 1").drop("_more")

    same = F.col("_slice") == F.col("_s")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    # A group that a slice continues is the first of that slice, so no slice has two: a row a slice.
    out = cut.withColumns(here).join(F.broadcast(carried), same, "left").withColumns(joined)
    return needs(out.select(*(c for c in df.columns if c not in carries), *carries), cut)


def asof_join(rows: DataFrame, marks: DataFrame, at: str | Column, mark_at: str | Column, by: tuple[str, ...] = (), *, strict: bool = False, slices: int | None = None) -> DataFrame:
    """Each row with the last mark at or (``strict``) before its place, of the same ``by``; rows without one stay, with nulls.

    Tables of any size: rows and marks are sorted as one, and marks are carried to the rows behind them.  A mark of a null
    place stands before all rows.  Marks of one place should be one; columns of the marks must have names of their own.
    """
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    mark_cols = [c for c in marks.columns if c not in by]
    lead = [F.col(c) for c in by]
    own = rows.select(*lead, as_col(at).alias("_at"), F.lit(0 if strict else 1).alias("_kind"), F.struct(*rows.columns).alias("_row"))
    theirs = marks.select(*lead, as_col(mark_at).alias("_at"), F.lit(1 if strict else 0).alias("_kind"), F.struct(*mark_cols).alias("_mark"))
    both = own.unionByName(theirs, allowMissingColumns=True)
    found = prefix_scan(both, list(by), ["_at", "_kind"], {"_mark": ("last", "_mark")}, slices=slices).where("_row IS NOT NULL")
    return found.select("_row.*", *(F.col("_mark")[c].alias(c) for c in mark_cols))
