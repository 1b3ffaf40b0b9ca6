"""Feed caches and alert deliveries, in batch."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from skyloom.operators.scans import prefix_scan
from skyloom.sources.shared import discard, saved, settled


#: Keys of more requests than this are many tasks' work; others pass through one each.
HOT_ROWS = 1_000_000


def replay_cache(requests: DataFrame, key: str, order: list[str], ts: str, ttl: str, ok: str, thrown: Column | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """State and age of every request of every key, in order, by the key's last stored time.

    A stored copy younger than the request's ttl is a HIT and stores nothing.  Else the feed is fetched: a success stores,
    as REVALIDATED or, the first time, as MISS; a failure serves the stored copy as STALE-ERR; without one it is MISS-ERR,
    or has no label where the fetch itself threw.  Times are seconds, and the order is theirs.  A request without a time
    comes first and leaves no copy; one without a ttl, or none above zero, is never a HIT.

    The history of a key of up to ``hot_rows`` requests passes in order through one task; that of a larger one is cut into
    slices of many tasks, and what is stored when is found by pointers from each success to the one that would store next.
    """
    thrown = F.lit(False) if thrown is None else thrown
    counts = requests.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows).select(key)
    hot = [r[0] for r in counts.limit(1_001).collect()]
    if not hot:
        return fold_replay(requests, key, order, ts, ttl, ok, thrown)
    if len(hot) <= 1_000:  # so few are named in the plan; more are met by a join
        named = F.coalesce(F.col(key).isin([k for k in hot if k is not None]), F.lit(False)) | (F.col(key).isNull() & F.lit(None in hot))
        large, small = requests.where(named), requests.where(~named)
    else:
        large = requests.join(counts.withColumnRenamed(key, "_hot"), F.col(key).eqNullSafe(F.col("_hot")), "left_semi")
        small = requests.join(counts.withColumnRenamed(key, "_hot"), F.col(key).eqNullSafe(F.col("_hot")), "left_anti")
    return fold_replay(small, key, order, ts, ttl, ok, thrown).unionByName(pointer_replay(large, key, order, ts, ttl, ok, thrown))


def pointer_replay(requests: DataFrame, key: str, order: list[str], ts: str, ttl: str, ok: str, thrown: Column, slices: int | None = None) -> DataFrame:
    """``replay_cache`` of long histories.

    After a copy of time s, the next success to store is the first one with time - ttl >= s.  As a running maximum of
    time - ttl never falls, that is a join to the nearest of an order.  The successes that do store are those that the
    pointers reach from a key's first one: after n rounds those within 2^n steps are known.  A success that is never a HIT
    stores whatever came before, so the history after it starts anew.
    """
    names = requests.columns
    t, life = F.col(ts).cast("double"), F.coalesce(F.col(ttl).cast("double"), F.lit(0.0))
    good = F.coalesce(F.col(ok).cast("boolean"), F.lit(False))
    rows = requests.select(*names, F.col(key).alias("_key"), t.alias("_t"), life.alias("_life"), good.alias("_good"), thrown.alias("_thrown"))
    timed = F.col("_t").isNotNull()
    always = timed & F.col("_good") & (F.col("_life") <= 0)
    numbered = prefix_scan(rows, ["_key"], order, {"_place": ("count", F.lit(1)), "_part": ("count", F.when(always, 1))}, slices=slices)
    numbered = settled(numbered, numbered, "history")

    part = ["_key", "_part"]
    stores = numbered.where(timed & F.col("_good")).select(*part, "_place", "_t", F.when(F.col("_life") > 0, F.col("_t") - F.col("_life")).alias("_from"))
    stores = prefix_scan(stores, part, ["_place"], {"_reach": ("max", "_from")}, slices=slices)
    stores = settled(stores, stores, "stores")
    # In falling order of time: a pointer is the last success seen, that is the first in time of those that reach so far.
    seen = stores.where("_from IS NOT NULL").select(*part, (-F.col("_reach")).alias("_at"), F.lit(0).alias("_kind"), (-F.col("_place")).alias("_back"), F.col("_place").alias("_next"))
    asks = stores.select(*part, (-F.col("_t")).alias("_at"), F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_back"), F.lit(None).cast("long").alias("_next"), "_place")
    links = prefix_scan(seen.withColumn("_place", F.lit(None).cast("long")).unionByName(asks), part, ["_at", "_kind", "_back"], {"_to": ("last", "_next")}, slices=slices)
    ahead = F.when(F.col("_to") > F.col("_place"), F.col("_to"))
    jumps = settled(links.where("_place IS NOT NULL").select(*part, "_place", ahead.alias("_to")), links, "jumps")

    # Merged by hint: by the size of their files many of these tables would be broadcast, each round anew through the driver.
    same = lambda a, b: F.col(f"{a}._key").eqNullSafe(F.col(f"{b}._key")) & (F.col(f"{a}._part") == F.col(f"{b}._part"))
    reached = saved(stores.groupBy(*part).agg(F.min("_place").alias("_place")), "reached")
    while True:
        new = reached.alias("r").join(jumps.where("_to IS NOT NULL").alias("j").hint("merge"), same("r", "j") & (F.col("r._place") == F.col("j._place"))).select("r._key", "r._part", F.col("j._to").alias("_place"))
        new = saved(new, "reached")
        if new.isEmpty():
            break
        more = saved(reached.union(new), "reached")
        farther = jumps.alias("a").join(jumps.alias("b").hint("merge"), same("a", "b") & (F.col("a._to") == F.col("b._place")), "left").select("a._key", "a._part", "a._place", "b._to")
        farther = saved(farther, "jumps")
        discard(reached, new, jumps)
        reached, jumps = more, farther

    marks = reached.select(F.col("_key").alias("_k"), F.col("_place").alias("_p"), F.lit(True).alias("_stores"))
    marked = numbered.join(marks.hint("merge"), F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_place") == F.col("_p")), "left")
    told = prefix_scan(marked, ["_key"], ["_place"], {"_stored": ("last", F.when(F.col("_stores"), F.col("_t")))}, inclusive=False, slices=slices)
    past = F.col("_t") - F.col("_stored")
    hit = F.coalesce(timed & (past >= 0) & (past < F.col("_life")), F.lit(False))
    state = F.when(hit, "HIT").when(F.col("_good"), F.when(F.col("_stored").isNull(), "MISS").otherwise("REVALIDATED"))
    state = state.when(F.col("_stored").isNotNull(), "STALE-ERR").when(F.col("_thrown") == F.lit(False), "MISS-ERR")
    age = F.when(hit, F.floor(past).cast("double")).when(F.col("_good"), 0.0)
    return told.select(*names, state.alias("state"), age.alias("age"))


def fold_replay(requests: DataFrame, key: str, order: list[str], ts: str, ttl: str, ok: str, thrown: Column) -> DataFrame:
    """``replay_cache`` of histories that one task may hold in order; it carries the stored time only, and rows leave as
    they come."""
    names = requests.columns
    inputs = [F.col(key).alias("_key"), F.col(ts).cast("double").alias("_t"), F.col(ttl).cast("double").alias("_ttl"), F.col(ok).alias("_ok"), thrown.alias("_thrown")]
    rows = requests.select(*names, *inputs).repartition(key).sortWithinPartitions(key, *order)

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stored = object(), None
        for batch in batches:
            states, ages = [], []
            for k, t, life, good, threw in zip(*(c.to_pylist() for c in batch.columns[len(names) :]), strict=True):
                if k != now:
                    now, stored = k, None
                if None not in (stored, t, life) and 0 <= t - stored < life:
                    state, age = "HIT", float(math.floor(t - stored))
                elif good:
                    state, age, stored = ("MISS" if stored is None else "REVALIDATED"), 0.0, t
                else:
                    state, age = ("STALE-ERR" if stored is not None else "MISS-ERR" if threw is False else None), None
                states.append(state)
                ages.append(age)
            out = [*batch.columns[: len(names)], pa.array(states, pa.string()), pa.array(ages, pa.float64())]
            yield pa.RecordBatch.from_arrays(out, names=[*names, "state", "age"])

    return rows.mapInArrow(replay, StructType(list(requests.schema.fields)).add("state", "string").add("age", "double"))


def last_good_value(df: DataFrame, key: str, order: list[str], value: str, ok: Column, at: Column | None = None, keep_seconds: float | None = None) -> DataFrame:
    """The last value of the key that was good, up to and with the row; a null value is none.  With ``at`` (seconds), one
    of ``keep_seconds`` before the row or more is forgotten."""
    good = F.when(ok & F.col(value).isNotNull(), F.struct(F.col(value).alias("value"), (F.lit(0.0) if at is None else at).alias("at")))
    out = prefix_scan(df, [key], order, {"_good": ("last", good)})
    fresh = F.lit(True) if at is None else at - F.col("_good.at") < keep_seconds
    return out.withColumn("served", F.when(fresh, F.col("_good.value"))).drop("_good")


def cache_effectiveness(replayed: DataFrame, host: str) -> DataFrame:
    counts = replayed.groupBy(host, "state").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(host)))


def deliver_once(alerts: DataFrame, key: list[str], order: str, sent: DataFrame | None = None) -> DataFrame:
    """The first delivery of each (subscription, alert id), and none that was sent before."""
    first = alerts.groupBy(*key).agg(F.min_by(F.struct(*(c for c in alerts.columns if c not in key)), order).alias("_r")).select(*key, "_r.*")
    return first if sent is None else first.join(sent.select(*key).distinct(), key, "left_anti")


def in_quiet_hours(hour: Column, start: Column, end: Column) -> Column:
    """From start up to end, over midnight where start is later; none where they are equal."""
    return F.when(start == end, F.lit(False)).when(start < end, (hour >= start) & (hour < end)).otherwise((hour >= start) | (hour < end))


def respect_quiet_hours(df: DataFrame, ts: str, tz: str, start: str, end: str) -> DataFrame:
    hour = F.hour(F.from_utc_timestamp(F.col(ts), F.col(tz)))
    return df.where(~in_quiet_hours(hour, F.col(start), F.col(end)))


def match_topics(df: DataFrame, topics: str, topic: str) -> DataFrame:
    return df.where(F.array_contains(F.col(topics), F.col(topic)))


def prune_dead(subs: DataFrame, log: DataFrame, key: str = "endpoint") -> DataFrame:
    """Without endpoints whose latest delivery answered 404 or 410."""
    dead = log.groupBy(key).agg(F.max_by("status", "ts").alias("status")).where(F.col("status").isin(404, 410))
    return subs.join(dead, key, "left_anti")


def current_subscriptions(log: DataFrame, key: str = "endpoint", order: list[str] | None = None) -> DataFrame:
    """The latest row of each endpoint, if it subscribes."""
    latest = log.groupBy(key).agg(F.max_by(F.struct(*(c for c in log.columns if c != key)), F.struct(*(order or ["ts"]))).alias("_r"))
    return latest.select(key, "_r.*").where("action = 'subscribe'")


def compact_payload(df: DataFrame, cols: list[str], limit: int = 4096) -> DataFrame:
    body = F.to_json(F.struct(*cols))
    return df.withColumn("payload", body).withColumn("too_long", F.octet_length("payload") > limit)
