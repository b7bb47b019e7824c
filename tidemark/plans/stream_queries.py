"""Queries that run a stream over a table until all of it is processed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.registry import query, shared_folder
from tidemark.sources import tables
from tidemark.sources.tables import table
from tidemark.streaming import aggregate, stateful


def _events(spark: SparkSession, base: str) -> DataFrame:
    schema = spark.read.parquet(f"{base}/events.parquet").schema
    # A pattern, since a stream takes a folder or a pattern but no single file.
    rows = spark.readStream.schema(schema).parquet(f"{base}/events.parque[t]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _table_of(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """What a stream has put out once its input is processed; a batch that runs again replaces its own folder."""
    folder = shared_folder(spark, name)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    aggregate.run_available(stream, sink, f"{folder}/state")
    return spark.read.parquet(f"{folder}/out").drop("batch")


_MARK = "(SELECT (epoch_us(max(ts)) // 1000 - 60000) * 1000 FROM events)"


@query(f"""
SELECT event_type, epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS bucket_us, count(*) AS n FROM events GROUP BY 1, 2
HAVING epoch_us(time_bucket(INTERVAL '1 hour', ts)) + 3600000000 <= {_MARK}
""")
def stream_hourly_counts(spark: SparkSession, base: str) -> DataFrame:
    """Buckets that the watermark has passed: those are final, and the state keeps the others only."""
    counts = aggregate.tumbling_counts(_events(spark, base), "ts", "event_type", "1 hour")
    out = _table_of(spark, counts, "hourly")
    return out.select("event_type", F.unix_micros("bucket").alias("bucket_us"), "n")


@query(f"""
WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 21600000000 THEN 1 ELSE 0 END AS b FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS n FROM s GROUP BY user_id, session
HAVING epoch_us(max(ts)) + 21600000000 <= {_MARK}
""")
def stream_session_windows(spark: SparkSession, base: str) -> DataFrame:
    """Built-in session windows that the watermark has closed: an event exactly a gap later still belongs."""
    found = aggregate.windowed_sessions(_events(spark, base), "user_id", "ts", "6 hours")
    out = _table_of(spark, found, "sessions")
    return out.select("user_id", F.unix_micros("ts_start").alias("start_us"), F.unix_micros("ts_end").alias("end_us"), "n")


@query("""
WITH RECURSIVE d AS (SELECT user_id, epoch_us(ts) AS tm, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
f AS (SELECT user_id, n, tm, tm AS kept, true AS accepted FROM d WHERE n = 1
  UNION ALL SELECT d.user_id, d.n, d.tm, CASE WHEN d.tm - kept >= 3600000000 THEN d.tm ELSE kept END, d.tm - kept >= 3600000000 FROM f JOIN d ON d.user_id = f.user_id AND d.n = f.n + 1)
SELECT user_id, tm AS ts_us, accepted, CASE WHEN NOT accepted THEN 'rate_limited' END AS reason FROM f
""")
def stream_accepted_touches(spark: SparkSession, base: str) -> DataFrame:
    """Rate-limited touches; the table is one batch, so none is out of order (tests have several batches)."""
    touches = aggregate.accepted_touches(_events(spark, base), "user_id", "ts", 3600)
    out = _table_of(spark, touches, "touches")
    return out.select("user_id", F.unix_micros("ts").alias("ts_us"), "accepted", "reason")


@query("""
SELECT 'e' || event_id AS event_id, CASE WHEN event_id % 9 = 0 THEN 'paused' WHEN event_type = 'error' THEN 'process' WHEN contains(props, ': 6') THEN 'title' END AS skipped,
  CASE WHEN event_id % 9 = 0 OR event_type = 'error' OR contains(props, ': 6') THEN NULL ELSE props END AS window_title FROM events
""")
def stream_ingested_events(spark: SparkSession, base: str) -> DataFrame:
    """Events that come in as JSON lines, with why some are skipped; skipped ones keep no text."""
    folder = shared_folder(spark, "ingest")
    events = table(spark, base, "events").select(
        F.concat(F.lit("e"), "event_id").alias("event_id"), F.col("event_type").alias("app_name"),
        F.col("props").alias("window_title"), (F.col("event_id") % 9 == 0).alias("paused"),
    )
    events.write.json(f"{folder}/in")
    stream = aggregate.ingested(tables.json_events(spark, f"{folder}/in"), [], ["ERROR"], [": 6"])
    return _table_of(spark, stream, "ingested").select("event_id", "skipped", "window_title")


@query("SELECT user_id, event_type, count(DISTINCT (user_id, event_type)) AS n FROM events GROUP BY 1, 2")
def stream_distinct_events(spark: SparkSession, base: str) -> DataFrame:
    """Events without those whose key was seen within a time; the time here is longer than the table."""
    once = aggregate.exact_duplicates(_events(spark, base).select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "400 days")
    return _table_of(spark, once, "distinct").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("""
WITH RECURSIVE d AS (SELECT user_id, epoch_us(ts) AS tm, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
f AS (SELECT user_id, n, tm, tm AS kept, true AS accepted, 1.0::DOUBLE AS fast, 1.0::DOUBLE AS mid, 1.0::DOUBLE AS warm, 1.0::DOUBLE AS cool FROM d WHERE n = 1
  UNION ALL SELECT user_id, n, tm, CASE WHEN ok THEN tm ELSE kept END, ok, CASE WHEN ok THEN fast * pow(2.0, -age / 3600) + 1 ELSE fast END, CASE WHEN ok THEN mid * pow(2.0, -age / 21600) + 1 ELSE mid END,
    CASE WHEN ok THEN warm * pow(2.0, -age / 86400) + 1 ELSE warm END, CASE WHEN ok THEN cool * pow(2.0, -age / 604800) + 1 ELSE cool END
  FROM (SELECT d.user_id, d.n, d.tm, kept, fast, mid, warm, cool, d.tm - kept >= 3600000000 AS ok, (d.tm - kept) / 1e6::DOUBLE AS age FROM f JOIN d ON d.user_id = f.user_id AND d.n = f.n + 1))
SELECT user_id, tm AS ts_us, accepted, round(0.4 * fast + 0.3 * mid + 0.2 * warm + 0.1 * cool, 6) AS score FROM f
""")
def stream_decaying_touches(spark: SparkSession, base: str) -> DataFrame:
    """Four decaying sums of each user's touches in keyed state with expiry; the table is one batch (tests have several, and see state end)."""
    touches = stateful.decaying_touches(_events(spark, base), "user_id", "ts", 3600, 40 * 86_400)
    out = _table_of(spark, touches, "decaying")
    return out.select("user_id", F.round(F.col("at") * 1e6).cast("long").alias("ts_us"), "accepted", F.round("score", 6).alias("score"))
