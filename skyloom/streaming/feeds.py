"""Streaming forms: landed files, deliveries exactly once, cache replay with keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from skyloom.sources.landed import path_exists


def poll_feed_stream(spark: SparkSession, folder: str, schema: str, pattern: str, fmt: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    """Landed files of a folder as a stream; the cadence is the trigger's of the writer."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(folder)


def deliver_once_stream(alerts: DataFrame, key: list[str], ts: str, delay: str = "48 hours") -> DataFrame:
    """First rows of each key; a key is forgotten after ``delay``."""
    return alerts.withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)


def write_unsent(batch: DataFrame, batch_id: int, sent_path: str, key: list[str], deliver: Callable[[DataFrame, int], None]) -> None:
    """For foreachBatch: each key is delivered by one batch, also where batches are replayed.

    A batch's new keys are written first, in a folder of the batch's own, against those of the batches before; what is
    delivered is what was written.  A marker says that it was: a replay after it delivers nothing, a replay before it the
    same rows under the same batch id, by which a sink may know them.
    """
    spark = batch.sparkSession
    own, done = f"{sent_path}/batch={batch_id}", f"{sent_path}-delivered/batch={batch_id}"
    if path_exists(spark, f"{done}/_SUCCESS"):
        return
    if not path_exists(spark, f"{own}/_SUCCESS"):
        fresh = batch.dropDuplicates(key)
        if path_exists(spark, f"{sent_path}/batch=*/_SUCCESS"):
            kinds = StructType([batch.schema[k] for k in key]).add("batch", "long")
            sent = spark.read.schema(kinds).parquet(sent_path).where(F.col("batch") < batch_id).drop("batch")
            fresh = fresh.join(sent, key, "left_anti")
        fresh.write.mode("overwrite").parquet(own)
    deliver(spark.read.schema(batch.schema).parquet(own), batch_id)
    spark.range(0).write.mode("overwrite").parquet(done)


def tumbling_counts(rows: DataFrame, ts: str, width: str, by: list[str], delay: str) -> DataFrame:
    """Rows of each window and ``by``, once the watermark (the latest time of the batches before, less ``delay``) has passed
    the window's end; rows whose window has ended by then are late and not counted, and its state is gone."""
    windowed = rows.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"), *by).agg(F.count("*").alias("n"))
    return windowed.select(F.col("w.start").alias("start"), *by, "n")


class LastGood(StatefulProcessor):
    """State: the last good value and its time, which a timer of the event time forgets.  A key's rows of a batch are taken
    in time order, so they are held together: few, where batches are bounded by files.  A key has one timer at most: one that
    finds a newer value sets itself anew, so that rows cost two calls to the state and no more."""

    def __init__(self, keep_us: int) -> None:
        self.keep = keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.good = handle.getValueState("good", "value double, at long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        value, at = was = self.good.get() or (None, None)
        out = []
        for r in sorted(rows, key=lambda r: (r.at, r.id)):
            if r.ok and r.value is not None:
                value, at = r.value, r.at
            out.append(Row(key=key[0], id=r.id, served=value if at is not None and r.at - at < self.keep else None))
        if (value, at) != tuple(was):
            self.good.update((value, at))
            if was[1] is None:
                self.handle.registerTimer((at + self.keep) // 1000 + 1)  # timers are of milliseconds
        return iter(out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:  # noqa: N802, N803
        ends = (self.good.get()[1] + self.keep) // 1000 + 1
        if ends <= timerValues.getCurrentWatermarkInMs():
            self.good.clear()
        else:
            self.handle.registerTimer(ends)
        return iter(())

    def close(self) -> None:
        pass


def last_good_value_stream(rows: DataFrame, keep_seconds: int, delay: str) -> DataFrame:
    """rows: key long, id long, ts timestamp, value double, ok boolean.  Each row with the last good value of its key of less
    than ``keep_seconds`` before, as rows come in time order; state of keys that fall silent goes when the watermark passes
    its time.  Rows behind the watermark are dropped.  Needs the RocksDB state store."""
    timed = rows.withColumn("at", F.unix_micros("ts")).withWatermark("ts", delay)
    return timed.groupBy("key").transformWithState(LastGood(keep_seconds * 1_000_000), "key long, id long, served double", "Append", "EventTime")


class CacheReplay(StatefulProcessor):
    """State: the time of the stored copy.  Rows of a batch are taken in time order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stored = handle.getValueState("stored", "c double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        stored = self.stored.get()[0] if self.stored.exists() else None
        out = []
        for r in pd.concat(list(rows)).sort_values(["t", "id"]).itertuples():
            if stored is not None and 0 <= r.t - stored < r.ttl:
                state, age = "HIT", float(int(r.t - stored))
            elif r.ok:
                state, age, stored = ("MISS" if stored is None else "REVALIDATED"), 0.0, r.t
            else:
                state, age = ("MISS-ERR" if stored is None else "STALE-ERR"), None
            out.append((key[0], r.id, state, age))
        if stored is not None:
            self.stored.update((stored,))
        yield pd.DataFrame(out, columns=["key", "id", "state", "age"])

    def close(self) -> None:
        pass


def replay_cache_stream(requests: DataFrame) -> DataFrame:
    """requests: key long, id long, t double (seconds), ttl double, ok boolean.  Needs the RocksDB state store."""
    return requests.groupBy("key").transformWithStateInPandas(CacheReplay(), "key long, id long, state string, age double", "Append", "None")
