"""Feed cache and alert delivery queries, batch and stream."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators import feeds as G
from skyloom.operators.joins import fan_out, observation_grid
from skyloom.plans.base import landing, query, table
from skyloom.streaming.feeds import deliver_once_stream, last_good_value_stream, poll_feed_stream, replay_cache_stream, tumbling_counts, write_unsent
from skyloom.streaming.upserts import subscription_changes, upsert_batch, upserted

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
REPLAY_SQL = """WITH RECURSIVE q AS (SELECT user_id, event_id, epoch(ts) AS t, 10800.0 * (1 + user_id % 5) AS ttl, event_type <> 'error' AS ok,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT user_id, event_id, rn, CASE WHEN ok THEN t END AS c, CASE WHEN ok THEN 'MISS' ELSE 'MISS-ERR' END AS state, CASE WHEN ok THEN 0.0::DOUBLE END AS age FROM q WHERE rn = 1
  UNION ALL SELECT q.user_id, q.event_id, q.rn, CASE WHEN q.t - f.c >= 0 AND q.t - f.c < q.ttl THEN f.c WHEN q.ok THEN q.t ELSE f.c END,
  CASE WHEN q.t - f.c >= 0 AND q.t - f.c < q.ttl THEN 'HIT' WHEN q.ok AND f.c IS NOT NULL THEN 'REVALIDATED' WHEN q.ok THEN 'MISS' WHEN f.c IS NOT NULL THEN 'STALE-ERR' ELSE 'MISS-ERR' END,
  CASE WHEN q.t - f.c >= 0 AND q.t - f.c < q.ttl THEN floor(q.t - f.c) WHEN q.ok THEN 0.0 END
  FROM f JOIN q ON q.user_id = f.user_id AND q.rn = f.rn + 1)
"""


def req(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return e.select("user_id", "event_id", "ts", "t", (10800.0 * (1 + F.col("user_id") % 5)).alias("ttl"), (F.col("event_type") != "error").alias("ok"))


@query("g1_replay_cache", REPLAY_SQL + "SELECT user_id, event_id, state, age FROM f")
def g1(spark: SparkSession, d: str) -> DataFrame:
    return G.replay_cache(req(spark, d), "user_id", ["ts", "event_id"], "t", "ttl", "ok").select("user_id", "event_id", "state", "age")


@query("g1_replay_of_hot_keys", REPLAY_SQL + "SELECT user_id, event_id, state, age FROM f")
def g1h(spark: SparkSession, d: str) -> DataFrame:
    """The same by pointers, with every key taken for a hot one."""
    return G.replay_cache(req(spark, d), "user_id", ["ts", "event_id"], "t", "ttl", "ok", hot_rows=0).select("user_id", "event_id", "state", "age")


@query("g3_cache_effectiveness", REPLAY_SQL + "SELECT user_id % 10 AS host, state, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id % 10), 6) AS share FROM f GROUP BY 1, 2")
def g3(spark: SparkSession, d: str) -> DataFrame:
    r = G.replay_cache(req(spark, d), "user_id", ["ts", "event_id"], "t", "ttl", "ok").withColumn("host", F.col("user_id") % 10)
    return G.cache_effectiveness(r, "host").withColumn("share", F.round("share", 6))


@query("g2_last_good_value", "SELECT event_id, last_value(CASE WHEN event_type <> 'error' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS served FROM events")
def g2(spark: SparkSession, d: str) -> DataFrame:
    return G.last_good_value(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value", F.col("event_type") != "error").select("event_id", "served")


ALERT = "a AS (SELECT user_id AS sub_id, regexp_extract(props, '([0-9]+)', 1) AS alert_id, event_id, ts, event_type FROM events)"


def alerts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("sub_id"), F.regexp_extract("props", "([0-9]+)", 1).alias("alert_id"), "event_id", "ts", "event_type")


@query("g4_deliver_once", f"WITH {ALERT} SELECT sub_id, alert_id, min(event_id) AS event_id FROM a WHERE NOT (sub_id % 10 = 0 AND alert_id IN (SELECT alert_id FROM a WHERE sub_id = 0)) GROUP BY 1, 2")
def g4(spark: SparkSession, d: str) -> DataFrame:
    a = alerts(spark, d)
    ids = a.where("sub_id = 0").select("alert_id").distinct()
    sent = ids.join(a.where("sub_id % 10 = 0").select("sub_id", "alert_id").distinct(), "alert_id")
    return G.deliver_once(a, ["sub_id", "alert_id"], "event_id", sent).select("sub_id", "alert_id", "event_id")


@query("g5_quiet_hours", "SELECT event_id FROM events WHERE NOT (CASE WHEN user_id % 2 = 0 THEN hour(ts + INTERVAL 9 HOUR) >= 22 OR hour(ts + INTERVAL 9 HOUR) < 7 ELSE hour(ts - INTERVAL 5 HOUR) >= 13 AND hour(ts - INTERVAL 5 HOUR) < 15 END)")
def g5(spark: SparkSession, d: str) -> DataFrame:
    even = F.col("user_id") % 2 == 0
    e = table(spark, d, "events").withColumns(
        {"at": F.col("ts").cast("timestamp"), "tz": F.when(even, "Asia/Tokyo").otherwise("-05:00"), "qs": F.when(even, 22).otherwise(13), "qe": F.when(even, 7).otherwise(15)}
    )
    return G.respect_quiet_hours(e, "at", "tz", "qs", "qe").select("event_id")


@query("g6_match_topics", "SELECT event_id FROM events WHERE event_type = CASE user_id % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'error' ELSE 'view' END OR event_type = 'purchase'")
def g6(spark: SparkSession, d: str) -> DataFrame:
    own = F.when(F.col("user_id") % 3 == 0, "click").when(F.col("user_id") % 3 == 1, "error").otherwise("view")
    return G.match_topics(table(spark, d, "events").withColumn("topics", F.array(own, F.lit("purchase"))), "topics", "event_type").select("event_id")


@query(
    "g7_prune_dead",
    "WITH l AS (SELECT user_id, last(CASE WHEN event_type = 'error' THEN 410 ELSE 201 END ORDER BY ts, event_id) AS s FROM events GROUP BY 1) SELECT DISTINCT c_custkey % 200 AS endpoint FROM customer WHERE c_custkey % 200 NOT IN (SELECT user_id FROM l WHERE s = 410)",
)
def g7(spark: SparkSession, d: str) -> DataFrame:
    subs = table(spark, d, "customer").select((F.col("c_custkey") % 200).alias("endpoint")).distinct()
    log = table(spark, d, "events").select(F.col("user_id").alias("endpoint"), F.when(F.col("event_type") == "error", 410).otherwise(201).alias("status"), F.struct("ts", "event_id").alias("ts"))
    return G.prune_dead(subs, log)


@query("g8_current_subscriptions", "SELECT user_id AS endpoint, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'view'")
def g8(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select(F.col("user_id").alias("endpoint"), "ts", "event_id", F.when(F.col("event_type") == "view", "unsubscribe").otherwise("subscribe").alias("action"))
    return G.current_subscriptions(log, "endpoint", ["ts", "event_id"]).select("endpoint", "event_id")


@query("g9_compact_payload", "SELECT doc_id, octet_length(encode('{\"doc_id\":' || doc_id || ',\"source\":\"' || source || '\"}')) > 26 AS too_long FROM documents")
def g9(spark: SparkSession, d: str) -> DataFrame:
    return G.compact_payload(table(spark, d, "documents"), ["doc_id", "source"], 26).select("doc_id", "too_long")


@query("j10_fan_out", "SELECT event_id, c_custkey FROM events JOIN customer ON c_nationkey = user_id % 25 WHERE event_type = 'error'")
def j10(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "events").where("event_type = 'error'").select("event_id", (F.col("user_id") % 25).cast("int").alias("place"))
    subs = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("place"))
    return fan_out(a, subs, ["place"]).select("event_id", "c_custkey")


def drain(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """Runs a stream over what has landed, into files, and reads them."""
    out = landing(spark)
    q = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).queryName(f"q{uuid.uuid4().hex}").start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """With the RocksDB state store."""
    name, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, store)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


@query("s9_poll_stream", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def s9(spark: SparkSession, d: str) -> DataFrame:
    return drain(poll_feed_stream(spark, d, EVENTS, "events.parquet").select("event_type"), spark).groupBy("event_type").agg(F.count("*").alias("n"))


@query("g4_deliver_once_stream", f"WITH {ALERT} SELECT DISTINCT sub_id, alert_id, ts::DATE AS day FROM a")
def g4s(spark: SparkSession, d: str) -> DataFrame:
    a = poll_feed_stream(spark, d, EVENTS, "events.parquet").select(
        F.col("user_id").alias("sub_id"), F.regexp_extract("props", "([0-9]+)", 1).alias("alert_id"), F.to_date("ts").alias("day"), F.col("ts").cast("timestamp").alias("ts")
    )
    return drain(deliver_once_stream(a, ["sub_id", "alert_id", "day"], "ts").select("sub_id", "alert_id", "day"), spark)


@query("g1_replay_cache_stream", REPLAY_SQL + "SELECT event_id, state, age FROM f")
def g1s(spark: SparkSession, d: str) -> DataFrame:
    """The keyed state of a stream over what has landed; it needs the RocksDB store."""
    e = poll_feed_stream(spark, d, EVENTS, "events.parquet")
    requests = e.select(
        F.col("user_id").alias("key"), F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"),
        (10800.0 * (1 + F.col("user_id") % 5)).cast("double").alias("ttl"), (F.col("event_type") != "error").alias("ok"),
    )
    with rocks(spark):
        return drain(replay_cache_stream(requests), spark).select(F.col("id").alias("event_id"), "state", "age")


BATCHES = 6


def arrivals(hours: int) -> str:
    """Events land in six batches by their time; one in seven comes two batches late.  A row is late if it lies behind the
    mark that the batch before its own ran with: the latest time of the batches before that one, less the delay."""
    return f"""ends AS (SELECT min(epoch_us(ts)) AS lo, (max(epoch_us(ts)) - min(epoch_us(ts))) // {BATCHES} + 1 AS step FROM events),
landed AS (SELECT *, least({BATCHES - 1}, (epoch_us(ts) - lo) // step + CASE WHEN event_id % 7 = 0 THEN 2 ELSE 0 END) AS batch FROM events, ends),
marks AS (SELECT n AS batch, (SELECT max(ts) FROM landed WHERE landed.batch < n - 1) - INTERVAL {hours} HOUR AS mark FROM range({BATCHES + 2}) b(n)),
arrived AS (SELECT landed.*, coalesce(mark, TIMESTAMP '1970-01-01') AS mark FROM landed JOIN marks USING (batch))"""


def land_in_batches(spark: SparkSession, d: str, late: bool = True) -> str:
    """A folder where events have landed batch after batch, a file each."""
    path = landing(spark)
    e = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    ends = e.agg(F.min("us").alias("lo"), F.max("us").alias("hi")).first()
    step = (ends["hi"] - ends["lo"]) // BATCHES + 1
    batch = F.floor((F.col("us") - ends["lo"]) / step) + (F.when(F.col("event_id") % 7 == 0, 2).otherwise(0) if late else F.lit(0))
    e = e.withColumn("batch", F.least(batch, F.lit(BATCHES - 1)))
    for n in range(BATCHES):
        e.where(F.col("batch") == n).drop("batch", "us").coalesce(1).write.mode("append").parquet(path)
    return path


def landed_stream(spark: SparkSession, path: str) -> DataFrame:
    return poll_feed_stream(spark, path, EVENTS, "*.parquet", files_per_batch=1).withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "s9_counts_over_batches",
    f"WITH {arrivals(12)} SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM arrived WHERE date_trunc('day', ts) + INTERVAL 1 DAY > mark"
    f" AND date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(mark) FROM marks) GROUP BY 1, 2",
)
def s9b(spark: SparkSession, d: str) -> DataFrame:
    """Six batches: a day's counts come when the watermark has passed it; rows of days that it has passed are late."""
    counts = tumbling_counts(landed_stream(spark, land_in_batches(spark, d)), "ts", "1 day", ["event_type"], "12 hours")
    return drain(counts, spark).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("g4_deliver_over_batches", f"WITH {arrivals(36)} SELECT DISTINCT user_id AS sub_id, regexp_extract(props, '([0-9]+)', 1) AS alert_id, ts::DATE AS day FROM arrived WHERE ts > mark")
def g4b(spark: SparkSession, d: str) -> DataFrame:
    """Six batches: each (subscription, alert, day) once, by its first row that is not behind the watermark.
    The delay is longer than a day, so a key's state outlives its day."""
    a = landed_stream(spark, land_in_batches(spark, d)).select(F.col("user_id").alias("sub_id"), F.regexp_extract("props", "([0-9]+)", 1).alias("alert_id"), F.to_date("ts").alias("day"), "ts")
    return drain(deliver_once_stream(a, ["sub_id", "alert_id", "day"], "ts", "36 hours").select("sub_id", "alert_id", "day"), spark)


KEPT_SQL = """SELECT event_id, CASE WHEN ts - good_ts < INTERVAL 1 DAY THEN good END AS served FROM (SELECT event_id, ts,
  last_value(CASE WHEN event_type <> 'error' THEN value END IGNORE NULLS) OVER w AS good, max(CASE WHEN event_type <> 'error' AND value IS NOT NULL THEN ts END) OVER w AS good_ts
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))"""


@query("g2_last_good_within_a_day", KEPT_SQL)
def g2k(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return G.last_good_value(e, "user_id", ["ts", "event_id"], "value", F.col("event_type") != "error", F.col("t"), 86_400).select("event_id", "served")


@query("g2_last_good_stream", KEPT_SQL)
def g2s(spark: SparkSession, d: str) -> DataFrame:
    """Six batches in time order; a key's value goes a day after it, by a timer."""
    e = landed_stream(spark, land_in_batches(spark, d, late=False))
    rows = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts", "value", (F.col("event_type") != "error").alias("ok"))
    with rocks(spark):
        return drain(last_good_value_stream(rows, 86_400, "1 hour"), spark).select(F.col("id").alias("event_id"), "served")


@query(
    "g8_upserted_subscriptions",
    "SELECT user_id AS endpoint, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_type NOT IN ('view', 'error')",
)
def g8u(spark: SparkSession, d: str) -> DataFrame:
    """Six batches, some rows late: subscriptions as a table of buckets; views unsubscribe, errors are endpoints that are gone."""
    out = landing(spark)
    e = landed_stream(spark, land_in_batches(spark, d))
    kind = F.col("event_type")
    changes = subscription_changes(e.select("user_id", "ts", "event_id", "event_type"), "user_id", F.when(kind == "view", "unsubscribe").otherwise("subscribe"), F.when(kind == "error", 410).otherwise(201))
    changes.writeStream.foreachBatch(lambda b, n: upsert_batch(b, n, f"{out}/table", ["endpoint"], ["ts", "event_id"], 16)).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return upserted(spark, f"{out}/table", changes.schema).where("change = 'subscribe'").select("endpoint", "event_id")


@query("g4_deliver_durably", f"WITH {ALERT} SELECT DISTINCT sub_id, alert_id FROM a")
def g4d(spark: SparkSession, d: str) -> DataFrame:
    """Batches of landed files, each delivered to a file sink by its id."""
    out = landing(spark)

    def each(batch: DataFrame, batch_id: int) -> None:
        write_unsent(batch, batch_id, f"{out}/sent", ["sub_id", "alert_id"], lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/inbox/delivery={n}"))

    a = poll_feed_stream(spark, d, EVENTS, "events.parquet").select(F.col("user_id").alias("sub_id"), F.regexp_extract("props", "([0-9]+)", 1).alias("alert_id"))
    a.writeStream.foreachBatch(each).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(a.schema).parquet(f"{out}/inbox").drop("delivery")


@query("j9_observation_grid", "SELECT day, event_type, n_name, count(*) AS n FROM (SELECT DISTINCT ts::DATE AS day FROM events), (SELECT DISTINCT event_type FROM events), nation GROUP BY ALL")
def j9(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    days = e.select(F.to_date("ts").alias("day")).distinct()
    return observation_grid(days, e.select("event_type").distinct(), table(spark, d, "nation").select("n_name")).groupBy("day", "event_type", "n_name").agg(F.count("*").alias("n"))
