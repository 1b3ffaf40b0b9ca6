"""Weighted rendezvous hashing: every record ranks all shards by a hash of (key, shard) and goes to the best one.

A shard of weight w scores w / -ln(u), u being uniform in (0, 1); the record's key and the shards decide alone, so a
new shard takes records only into itself, and a shard's share is its weight's.  All in built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_ROWS = 200_000
HASH_DIGITS = 12  # hexadecimal digits of md5 kept: 48 bits, exact in a double


def unit_hash(text: Column) -> Column:
    """Uniform in (0, 1), alike in every engine that has md5."""
    high = F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_DIGITS), 16, 10).cast("double")
    return (high + 0.5) / F.lit(float(16**HASH_DIGITS))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard (0-based) that wins the key.  Ties go to the lowest shard; shards of weight 0 win nothing."""
    scored = [
        F.struct(
            (-(F.lit(float(w)) / F.log(unit_hash(F.concat_ws("/", key, F.lit(str(i))))))).alias("score"),
            F.lit(-i).alias("low"),
        )
        for i, w in enumerate(weights)
        if w > 0
    ]
    if not scored:
        raise ValueError("a shard of positive weight is needed")
    best = F.greatest(*scored) if len(scored) > 1 else scored[0]
    return (-best["low"]).cast("int")


def shard_records(
    documents: DataFrame,
    weights: list[float],
    grown: list[float] | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Shard whole documents by doc_id; number each shard's records without gaps.

    Returns doc_id, size (UTF-8 bytes + 16), text_crc32, law ('key'), shard, slot, and grown_shard under ``grown``
    weights (null without them).  A null text has no bytes and the crc32 of the empty text; a null doc_id is the key
    ''.  Rows repeating an id share its shard and get slots of their own; rows alike in id, size and text are in either
    order.  Whole texts are measured, however long.  An empty table gives an empty result; other columns are ignored.
    Slots are numbered within slices of a shard, whose offsets come from a table of shards x slices counts, so that no
    task holds a whole shard: 64 slices, or as many as make SLICE_ROWS rows each.
    """
    if slices is None:
        slices = min(16**4, max(64, documents.count() // (SLICE_ROWS * len(weights))))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    text = F.coalesce(documents["text"].cast("string"), F.lit("")).cast("binary")
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(key, weights).alias("shard"),
        (rendezvous(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        (F.conv(F.substring(F.md5(F.concat(key, F.lit("/slice")).cast("binary")), 1, 4), 16, 10).cast("int") % slices).alias("slice"),
    )
    counts = rows.groupBy("shard", "slice").agg(F.count("*").alias("n"))
    starts = counts.selectExpr(
        "shard", "slice", "sum(n) OVER (PARTITION BY shard ORDER BY slice) - n AS first"
    )  # shards x slices rows at most
    numbered = rows.selectExpr(
        "*", "row_number() OVER (PARTITION BY shard, slice ORDER BY doc_id, text_crc32, size) - 1 AS within"
    )
    return numbered.join(F.broadcast(starts), ["shard", "slice"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", (F.col("first") + F.col("within")).cast("long").alias("slot"), "grown_shard"
    )
