"""Small tables: literal ones, whose size Spark knows, and the check that a side of a join is small enough to broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A side of a join is broadcast only if it was counted to hold no more than this.
SMALL_ROWS, SMALL_BYTES = 100_000, 16 << 20


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of values in the plan itself."""

    def cell(v: object) -> str:
        if v is None or isinstance(v, bool):
            return "NULL" if v is None else str(v)
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"{v!r}D" if isinstance(v, float) else repr(v)

    fields = StructType.fromDDL(schema).fields
    if not rows:
        return spark.createDataFrame([], schema)
    cols = ", ".join(f"CAST(c{i} AS {f.dataType.simpleString()}) AS `{f.name}`" for i, f in enumerate(fields))
    cells = ", ".join(f"({', '.join(map(cell, r))})" for r in rows)
    out = spark.sql(f"SELECT {cols} FROM VALUES {cells} AS t({', '.join(f'c{i}' for i in range(len(fields)))})")
    out._literal_rows = len(rows)
    return out


def fits(df: DataFrame, rows: int = SMALL_ROWS, size: int = SMALL_BYTES) -> bool:
    """Whether a table holds no more rows and bytes than given; counted in one pass over it, unless it is a literal one."""
    known = getattr(df, "_literal_rows", None)
    if known is not None:
        return known <= rows
    found = df.agg(F.count("*").alias("rows"), F.sum(F.octet_length(F.to_json(F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in df.columns))))).alias("bytes")).first()
    return found["rows"] <= rows and (found["bytes"] or 0) <= size


def small_side(df: DataFrame, *cols: str) -> DataFrame:
    """The table (of the given columns) for a join: marked for a broadcast if it fits, else as it is."""
    picked = df.select(*cols) if cols else df
    return F.broadcast(picked) if fits(df if hasattr(df, "_literal_rows") else picked) else picked
