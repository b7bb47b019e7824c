"""Queries: browsing, facets, scans, tables changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import browse, writes
from tidemark.plans.registry import micros, query, shared_folder
from tidemark.sources import versions
from tidemark.sources.tables import table

AS_OF = "2024-01-31 00:00:00"


@query("""
SELECT event_id, event_type, epoch_us(ts) AS ts_us, value FROM events
WHERE event_type IN ('click', 'view') AND value IS NOT NULL ORDER BY ts DESC, event_id DESC LIMIT 100
""")
def event_browse_page(spark: SparkSession, base: str) -> DataFrame:
    where = browse.EventFilter(equals=(("event_type", ("click", "view")),), present=(("value", True),))
    rows = browse.page(table(spark, base, "events"), where)
    return rows.select("event_id", "event_type", micros("ts").alias("ts_us"), "value")


@query("""
SELECT event_id, epoch_us(ts) AS ts_us FROM events
WHERE ts < TIMESTAMP '2024-01-15 12:00:00' OR (ts = TIMESTAMP '2024-01-15 12:00:00' AND event_id < 500)
ORDER BY ts DESC, event_id DESC LIMIT 100
""")
def event_browse_keyset(spark: SparkSession, base: str) -> DataFrame:
    cursor = browse.encode_cursor("2024-01-15 12:00:00", 500)
    rows = browse.page(table(spark, base, "events"), browse.EventFilter(), cursor=cursor)
    return rows.select("event_id", micros("ts").alias("ts_us"))


@query("""
SELECT event_id, event_type FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'
AND lower(event_type) LIKE '%i%' AND lower(props) LIKE '%1%'
""")
def event_filter_bundle(spark: SparkSession, base: str) -> DataFrame:
    where = browse.EventFilter("2024-01-05", "2024-01-20", contains=(("event_type", "I"), ("props", "1")))
    return table(spark, base, "events").where(where.column()).select("event_id", "event_type")


@query("""
SELECT event_type AS value, count(*) AS n FROM events WHERE event_type IS NOT NULL
GROUP BY 1 ORDER BY n DESC, value LIMIT 50
""")
def event_facets_type(spark: SparkSession, base: str) -> DataFrame:
    return browse.facets(table(spark, base, "events"), "event_type")


@query("""
SELECT source AS value, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 50
""")
def doc_facets_source(spark: SparkSession, base: str) -> DataFrame:
    return browse.facets(table(spark, base, "documents"), "source")


@query("""
SELECT count(*) FILTER (o_orderstatus = 'O') AS pending, count(*) FILTER (o_orderstatus = 'P') AS processing,
       count(*) FILTER (o_orderstatus = 'F') AS done FROM orders
""")
def queue_status_counts(spark: SparkSession, base: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return browse.status_counts(
        table(spark, base, "orders"), pending=status == "O", processing=status == "P", done=status == "F"
    )


@query("""
SELECT 'events' AS name, count(*) AS n FROM events WHERE ts BETWEEN TIMESTAMP '1998-01-10' AND TIMESTAMP '2024-01-20'
UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1998-01-10' AND TIMESTAMP '2024-01-20'
UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1998-01-10' AND TIMESTAMP '2024-01-20'
""")
def delete_preview(spark: SparkSession, base: str) -> DataFrame:
    times = {"events": "ts", "orders": "o_orderdate", "lineitem": "l_shipdate"}
    tables = {name: (table(spark, base, name), ts) for name, ts in times.items()}
    return browse.delete_preview(tables, "1998-01-10", "2024-01-20")


_HISTORY = """
SELECT trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) AS normalised, count(*) AS uses,
       max(TIMESTAMP '2023-06-01' + to_minutes(p_partkey)) AS last_used FROM part GROUP BY 1
"""


def _history(spark: SparkSession, base: str) -> DataFrame:
    used = F.timestamp_micros(F.lit(1685577600000000) + F.col("p_partkey") * 60_000_000)
    return browse.query_history(table(spark, base, "part").withColumn("ts", used), "p_name")


@query(f"SELECT normalised, uses, epoch_us(last_used) AS last_us FROM ({_HISTORY})")
def query_history(spark: SparkSession, base: str) -> DataFrame:
    return _history(spark, base).select("normalised", "uses", micros("last_used").alias("last_us"))


@query(f"""
WITH h AS ({_HISTORY}), m AS (
  SELECT * FROM h WHERE starts_with(normalised, 'red') ORDER BY last_used DESC, normalised LIMIT 30
)
SELECT normalised, uses, round(1 + 0.3 * sqrt(uses) + 0.3 / (1 + greatest(
  (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_used)) / 3.6e9, 0)), 6)::DOUBLE AS score
FROM m ORDER BY score DESC, normalised LIMIT 8
""")
def suggest_prefix(spark: SparkSession, base: str) -> DataFrame:
    return browse.suggest(_history(spark, base), "red", AS_OF).select("normalised", "uses", "score")


@query("""
SELECT event_id, 0.4::DOUBLE AS score FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'
ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 10
""")
def time_range_scan(spark: SparkSession, base: str) -> DataFrame:
    rows = browse.range_scan(table(spark, base, "events"), "2024-01-10", "2024-01-12", limit=50, offset=10)
    return rows.select("event_id", "score")


@query("""
SELECT doc_id, 0.4::DOUBLE AS score FROM documents
WHERE lower(coalesce(text, '') || chr(10) || coalesce(source, '')) LIKE '%licensed under%' ORDER BY doc_id LIMIT 100
""")
def substring_fallback(spark: SparkSession, base: str) -> DataFrame:
    rows = browse.substring_search(table(spark, base, "documents"), ["text", "source"], "Licensed under", "doc_id")
    return rows.select("doc_id", "score")


@query(f"""
SELECT ts < TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY AND event_type <> 'error' AS expired, count(*) AS n FROM events GROUP BY 1
""")
def retention_split(spark: SparkSession, base: str) -> DataFrame:
    rows = browse.retention_split(table(spark, base, "events"), AS_OF, 20, safe=F.col("event_type") != "error")
    return rows.groupBy("expired").agg(F.count("*").alias("n"))


@query("""
WITH t AS (SELECT *, sum(length(props)) OVER (ORDER BY ts DESC, event_id DESC) AS upto FROM events)
SELECT event_id, upto > 40000 AS "over" FROM t
""")
def quota_prune(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "events").withColumn("size", F.length("props"))
    return browse.quota_prune(rows, "size", 40000, "ts", "event_id").select("event_id", "over")


@query("""
SELECT d::DATE AS day, coalesce(n, 0) AS n
FROM range(TIMESTAMP '2023-12-30', TIMESTAMP '2024-02-03', INTERVAL 1 DAY) r(d)
LEFT JOIN (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1) e ON e.day = d::DATE
""")
def daily_rollup(spark: SparkSession, base: str) -> DataFrame:
    return browse.daily_rollup(table(spark, base, "events"), "2023-12-30", "2024-02-02")


# --- table changes -----------------------------------------------------------------------------


@query("""
WITH n AS (SELECT event_id, ts + INTERVAL 1 HOUR AS ts, value + 1 AS value FROM events WHERE event_id % 3 = 0
           UNION ALL SELECT event_id + 1000000000, ts, value FROM events WHERE event_id % 7 = 0)
SELECT event_id, epoch_us(ts) AS ts_us, value FROM n
UNION ALL SELECT event_id, epoch_us(ts), value FROM events WHERE event_id NOT IN (SELECT event_id FROM n)
""")
def latest_wins_upsert(spark: SparkSession, base: str) -> DataFrame:
    old = table(spark, base, "events").select("event_id", "ts", "value")
    changed = old.where("event_id % 3 = 0").withColumns({"ts": F.expr("ts + interval 1 hour"), "value": F.col("value") + 1})
    fresh = old.where("event_id % 7 = 0").withColumn("event_id", F.col("event_id") + 1_000_000_000)
    out = writes.latest_wins(old, changed.unionByName(fresh), ["event_id"], F.desc("ts"))
    return out.select("event_id", micros("ts").alias("ts_us"), "value")


@query("""
SELECT o_orderkey, o_totalprice FROM orders
UNION ALL SELECT o_orderkey + 1000000000, o_totalprice FROM orders WHERE o_orderkey % 5 = 0
""")
def insert_ignore(spark: SparkSession, base: str) -> DataFrame:
    old = table(spark, base, "orders").select("o_orderkey", "o_totalprice")
    fresh = old.where("o_orderkey % 5 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000_000)
    again = old.where("o_orderkey % 2 = 0").withColumn("o_totalprice", F.lit(0.0))
    return writes.insert_ignore(old, fresh.unionByName(again), ["o_orderkey"])


@query("""
SELECT user_id, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 5
""")
def keep_newest_n(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "events").select("user_id", "event_id", "ts")
    return writes.keep_newest(rows, "user_id", 5, F.desc("ts"), F.desc("event_id")).select("user_id", "event_id")


@query("""
SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1
""")
def latest_per_key(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return writes.keep_newest(rows, "o_custkey", 1, F.desc("o_orderdate"), F.desc("o_orderkey")).drop("o_orderdate")


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND row_number() OVER (
  PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, o_orderdate DESC, o_orderkey DESC) = 1 THEN 'active'
  WHEN o_orderstatus = 'F' THEN 'deprecated' ELSE 'proposed' END AS state FROM orders
""")
def promote_items(spark: SparkSession, base: str) -> DataFrame:
    items = table(spark, base, "orders").withColumn("sourced", F.col("o_orderstatus") == "F")
    return writes.promote(items, "o_custkey", F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_orderkey", "state")


@query("""
WITH gone AS (SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31')
SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM gone) GROUP BY 1
""")
def cascade_delete(spark: SparkSession, base: str) -> DataFrame:
    orders = table(spark, base, "orders").select("o_orderkey", "o_orderdate")
    kept = writes.delete_range(orders, "o_orderdate", "1995-01-01", "1996-12-31")
    gone = orders.join(kept, "o_orderkey", "left_anti")
    left = writes.cascade(table(spark, base, "lineitem"), "l_orderkey", gone, "o_orderkey")
    return left.groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("""
SELECT user_id, count(*) AS attempts, CASE WHEN bool_or(event_type = 'purchase') THEN 'done'
  WHEN count(*) >= 60 THEN 'failed' ELSE 'pending' END AS state FROM events GROUP BY 1
""")
def job_states(spark: SparkSession, base: str) -> DataFrame:
    log = table(spark, base, "events").withColumn("ok", F.col("event_type") == "purchase")
    return writes.job_states(log, "user_id", "ts", 60)


@query("""
WITH s AS (SELECT doc_id, text, unnest(range(0, length(text), 2000)) AS start FROM documents WHERE length(text) > 0)
SELECT doc_id, start::INT AS start, NOT (doc_id % 10 = 0 AND start + 2000 >= length(text)) AS valid FROM s
""")
def verify_slices(spark: SparkSession, base: str) -> DataFrame:
    """Whole texts in slices of 2,000 characters; the last one of every tenth document was changed."""
    docs = table(spark, base, "documents").where(F.length("text") > 0).select("doc_id", "text")
    cut = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(2000))).alias("start"))
    last = F.col("start") + 2000 >= F.length("text")
    own = F.when((F.col("doc_id") % 10 == 0) & last, "changed").otherwise(F.substring(F.col("text"), F.col("start") + 1, F.lit(2000)))
    spans = cut.select("doc_id", "start", F.least(F.col("start") + 2000, F.length("text")).alias("end"), own.alias("span_text"))
    spans = spans.withColumn("span_hash", F.sha2("span_text", 256))
    return writes.verify_slices(spans, docs, "doc_id").select("doc_id", "start", "valid")


# --- tables that are changed part by part ---------------------------------------------------------


@query("""
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 50 = 0 THEN 'Z' ELSE o_orderstatus END AS status, o_custkey AS customer FROM orders WHERE o_orderkey % 1000 <> 7
UNION ALL SELECT o_orderkey + 100000000, 'N', o_custkey FROM orders WHERE o_orderkey % 50 = 1
""")
def versioned_upsert(spark: SparkSession, base: str) -> DataFrame:
    """A table of orders after an upsert, an insert of what is new only, and a deletion by key, each published as a version."""
    folder = shared_folder(spark, "orders")
    rows = table(spark, base, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer"))
    versions.create(rows, folder, "id", parts=16)
    versions.upsert(spark, folder, rows.where("id % 50 = 0").withColumn("status", F.lit("Z")))
    new = rows.where("id % 50 = 1").select((F.col("id") + 100_000_000).alias("id"), F.lit("N").alias("status"), "customer")
    versions.insert_new(spark, folder, new.unionByName(rows.where("id % 50 = 2").withColumn("status", F.lit("kept as it was"))))
    versions.delete_keys(spark, folder, rows.where("id % 1000 = 7"))
    return versions.read(spark, folder)


@query("""
WITH gone AS (SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' AND event_type <> 'click'),
k AS (SELECT * FROM events WHERE event_id NOT IN (SELECT event_id FROM gone)),
p AS (SELECT event_id, unnest(regexp_extract_all(lower(props), '[a-z0-9_]+')) AS term FROM k)
SELECT 'events' AS name, count(*) AS n FROM k UNION ALL SELECT 'segments', count(*) FROM (SELECT DISTINCT event_id // 10 FROM k)
UNION ALL SELECT 'index', count(*) FROM (SELECT DISTINCT event_id, term FROM p)
""")
def versioned_range_delete(spark: SparkSession, base: str) -> DataFrame:
    """What is left of events, of the segments that they make up and of their index after a range was deleted from all three."""
    folder = shared_folder(spark, "range")
    events = table(spark, base, "events").select("event_id", "ts", "event_type", "props")
    segments = events.groupBy(F.expr("event_id div 10").alias("segment_id")).agg(F.collect_list("event_id").alias("ids"))
    terms = events.select("event_id", F.explode(F.array_distinct(text.terms(F.col("props")))).alias("term"))
    index = terms.withColumn("id", F.concat_ws(":", "event_id", "term"))
    for rows, name, key in ((events, "events", "event_id"), (segments, "segments", "segment_id"), (index, "index", "id")):
        versions.create(rows, f"{folder}/{name}", key, parts=8)
    late = (F.col("ts") >= F.lit("2024-01-10").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-20").cast("timestamp"))
    gone = events.where(late & (F.col("event_type") != "click")).select("event_id")
    versions.delete_where(spark, f"{folder}/events", late & (F.col("event_type") != "click"))
    versions.delete_keys(spark, f"{folder}/index", index.join(gone, "event_id", "left_semi"))
    left = versions.read(spark, f"{folder}/events").select(F.expr("event_id div 10").alias("segment_id")).distinct()
    versions.delete_keys(spark, f"{folder}/segments", segments.join(left, "segment_id", "left_anti"))
    counts = [versions.read(spark, f"{folder}/{n}").agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("events", "segments", "index")]
    return counts[0].union(counts[1]).union(counts[2])
