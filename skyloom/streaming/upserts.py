"""A table of the latest row of each key, kept under a stream's batches in hash buckets of which only touched ones are written."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skyloom.sources.landed import get_text, put_text
from skyloom.sources.shared import discard, folder, saved

STATE = "STATE"


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in key)), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def state_of(spark: SparkSession, path: str) -> dict:
    """The last batch that was taken in, where each bucket's rows are, and folders that nothing new will read."""
    text = get_text(spark, f"{path}/{STATE}")
    return json.loads(text) if text else {"batch": -1, "buckets": {}, "stale": []}


def upsert_batch(batch: DataFrame, batch_id: int, path: str, key: list[str], order: list[str], buckets: int = 64) -> None:
    """For foreachBatch: takes the latest rows of a batch in.

    A row replaces its key's if it is later by ``order``, whatever batch brings it.  The buckets that the batch touches are
    written anew in a folder of the batch's own, then one small file is replaced: until that, readers see the table as it
    was before, and a batch that is run again writes the same folder again.  One that was taken in already does nothing.
    Folders go when the batch after the next one is in, so a reader has a batch's time to finish.
    """
    spark = batch.sparkSession
    state = state_of(spark, path)
    if batch_id <= state["batch"]:
        return
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    fresh = saved(latest(batch, key, order), "batch")
    touched = [r[0] for r in fresh.select(bucket.alias("b")).distinct().collect()]  # as many as there are buckets at most
    own = f"batch={batch_id}"
    if touched:
        there = [f"{path}/{state['buckets'][str(b)]}/bucket={b}" for b in touched if str(b) in state["buckets"]]
        rows = fresh if not there else latest(fresh.unionByName(spark.read.schema(fresh.schema).parquet(*there)), key, order)
        rows.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{own}")
    stale = [f"{state['buckets'][str(b)]}/bucket={b}" for b in touched if str(b) in state["buckets"]]
    now = {"batch": batch_id, "buckets": state["buckets"] | {str(b): own for b in touched}, "stale": stale}
    put_text(spark, f"{path}/{STATE}", json.dumps(now))
    for gone in state["stale"]:
        fs, where = folder(spark, f"{path}/{gone}")
        fs.delete(where, True)
    discard(fresh)


def upserted(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table as of the last batch that was taken in."""
    there = [f"{path}/{own}/bucket={b}" for b, own in sorted(state_of(spark, path)["buckets"].items())]
    return spark.read.schema(schema).parquet(*there) if there else spark.createDataFrame([], schema)


def subscription_changes(log: DataFrame, endpoint: str, action: Column, status: Column) -> DataFrame:
    """Subscriptions and deliveries as one log of changes: endpoint, change and the log's other columns.  A delivery that
    was answered 404 or 410 ends the subscription, until a later row subscribes again; other deliveries change nothing."""
    change = F.when(status.isin(404, 410), "gone").otherwise(action)
    return log.withColumn("change", change).where("change IS NOT NULL").withColumnRenamed(endpoint, "endpoint")
