"""Queries: sessions, as-of context, hotness, memory ranking, graph expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scoring
from tidemark.operators import memory, ordered, sessions
from tidemark.plans.registry import micros, query
from tidemark.plans.search_queries import TERMS, _bm25, _bm25_sql
from tidemark.sources.tables import table

AS_OF = "2024-01-31 00:00:00"


def _events(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "events")


def _now():
    return F.lit(AS_OF).cast("timestamp")


_THREADS = """
g AS (SELECT *, row_number() OVER w AS n, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 / 60 AS gap,
        lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
t AS (SELECT *, sum(CASE WHEN n > 1 AND (gap > 360 OR event_type <> before) THEN 1 ELSE 0 END)
        OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS thread FROM g)
"""


def _threads(spark: SparkSession, base: str) -> DataFrame:
    rows = _events(spark, base).select("user_id", "event_id", "ts", "event_type")
    return sessions.threads(rows, "user_id", "ts", "event_id", "event_type", minutes=360)


@query(f"WITH {_THREADS} SELECT user_id, event_id, thread FROM t")
def thread_segments(spark: SparkSession, base: str) -> DataFrame:
    return _threads(spark, base).select("user_id", "event_id", "thread")


@query(f"""
WITH {_THREADS}
SELECT user_id, thread, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, arg_min(event_type, (ts, event_id)) AS first_app,
  arg_max(event_type, (ts, event_id)) AS last_app, count(*) AS n_events FROM t GROUP BY 1, 2
""")
def thread_rollup(spark: SparkSession, base: str) -> DataFrame:
    out = sessions.rollup(_threads(spark, base), "user_id", "thread", "ts", "event_id", "event_type")
    return out.select(
        "user_id", "thread", micros("ts_start").alias("start_us"), micros("ts_end").alias("end_us"),
        "first_app", "last_app", "n_events",
    )


@query("""
SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1)::INT AS position FROM conversations
""")
def thread_membership(spark: SparkSession, base: str) -> DataFrame:
    rows = sessions.positions(table(spark, base, "conversations"), "conv_id", "turn", "role", "text")
    return rows.select("conv_id", "turn", "position")


_SESSIONS = """
g AS (SELECT *, CASE WHEN (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 >= 21600
        THEN 1 ELSE 0 END AS b FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM g)
"""


@query(f"WITH {_SESSIONS} SELECT user_id, session, count(*) AS n, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us FROM s GROUP BY 1, 2")
def session_windows(spark: SparkSession, base: str) -> DataFrame:
    own = sessions.gap_sessions(_events(spark, base), "user_id", "ts", "event_id", 21600)
    return own.groupBy("user_id", "session").agg(
        F.count("*").alias("n"), micros(F.min("ts")).alias("start_us"), micros(F.max("ts")).alias("end_us")
    )


@query("""
SELECT event_type, epoch_us(time_bucket(INTERVAL '5 seconds', ts)) AS bucket_us, count(*) AS n FROM events GROUP BY 1, 2
""")
def tumbling_5s_buckets(spark: SparkSession, base: str) -> DataFrame:
    out = sessions.tumbling(_events(spark, base), ["event_type"], "ts", 5)
    return out.select("event_type", micros("bucket").alias("bucket_us"), "n")


@query("""
WITH RECURSIVE d AS (SELECT user_id, epoch_ms(ts) AS ms, CASE WHEN event_type = 'view' THEN 'keyboard' WHEN event_type = 'error' THEN 'foreground' ELSE 'mouse' END AS device,
  CASE event_type WHEN 'click' THEN 1 ELSE 0 END AS clicks, CASE event_type WHEN 'purchase' THEN event_id % 2 ELSE 0 END AS wheel,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f(user_id, n, session, bucket, last, start, content, own) AS (
  SELECT user_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, false, NULL::VARCHAR FROM (SELECT DISTINCT user_id FROM d)
  UNION ALL
  SELECT user_id, n, s, CASE WHEN device = 'foreground' THEN k + (st IS NOT NULL)::INT WHEN done THEN k + 1 ELSE k END,
    CASE WHEN device = 'foreground' THEN la ELSE ms END,
    CASE WHEN device = 'foreground' OR done THEN NULL ELSE coalesce(st, ms) END,
    CASE WHEN device = 'foreground' OR done THEN false ELSE co END, CASE WHEN device <> 'foreground' THEN s || ':' || k END
  FROM (SELECT *, ms - coalesce(st, ms) >= 3600000 OR (device = 'mouse' AND co) AS done FROM (
    SELECT d.*, s, k, la, st, (st IS NOT NULL AND c0) OR device = 'keyboard' OR clicks > 0 OR wheel > 0 AS co FROM (
      SELECT f.user_id AS u, f.n AS before, CASE WHEN over THEN session + 1 ELSE session END AS s, CASE WHEN over THEN bucket + (start IS NOT NULL)::INT ELSE bucket END AS k,
        CASE WHEN over THEN NULL ELSE last END AS la, CASE WHEN over THEN NULL ELSE start END AS st, content AND NOT over AS c0
      FROM (SELECT f.*, last IS NOT NULL AND ms - last >= 21600000 AS over FROM f JOIN d ON d.user_id = f.user_id AND d.n = f.n + 1) f) g
    JOIN d ON d.user_id = u AND d.n = before + 1)))
SELECT user_id, session, bucket, count(*) AS n, sum((device = 'keyboard')::INT)::BIGINT AS keyboard_events, sum(clicks)::BIGINT AS mouse_left_clicks, sum(wheel)::BIGINT AS mouse_wheel_events
FROM (SELECT f.user_id, string_split(own, ':')[1]::BIGINT AS session, string_split(own, ':')[2]::BIGINT AS bucket, device, clicks, wheel FROM f JOIN d USING (user_id, n) WHERE own IS NOT NULL)
GROUP BY 1, 2, 3
""")
def input_buckets(spark: SparkSession, base: str) -> DataFrame:
    kind = F.col("event_type")
    rows = _events(spark, base).select(
        "user_id", "event_id", "ts",
        F.when(kind == "view", "keyboard").when(kind == "error", "foreground").otherwise("mouse").alias("device"),
        F.when(kind == "click", 1).otherwise(0).alias("mouse_left_clicks"),
        F.when(kind == "purchase", F.col("event_id") % 2).otherwise(0).alias("mouse_wheel_events"),
    )
    out = sessions.input_buckets(rows, "user_id", "ts", "event_id", "device", 3600, 21600)
    return out.select("user_id", "session", "bucket", "n", "keyboard_events", "mouse_left_clicks", "mouse_wheel_events")


@query("""
SELECT event_id, (SELECT max((e2.ts, e2.event_id)) FROM events e2 WHERE e2.user_id = e.user_id AND e2.event_type = 'view' AND e2.ts <= e.ts)[2] AS context
FROM events e
""")
def asof_context(spark: SparkSession, base: str) -> DataFrame:
    seen = F.when(F.col("event_type") == "view", F.col("event_id"))
    return sessions.as_of_context(_events(spark, base), "user_id", "ts", "event_id", seen).select("event_id", "context")


@query("""
WITH r AS (SELECT o_custkey, o_orderdate + INTERVAL 24 YEAR AS at, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2)
SELECT event_id, r.o_orderkey FROM events e ASOF LEFT JOIN r ON e.user_id = r.o_custkey AND e.ts >= r.at
""")
def asof_join(spark: SparkSession, base: str) -> DataFrame:
    orders = table(spark, base, "orders").withColumn("at", F.expr("o_orderdate + interval 24 year"))
    right = orders.groupBy("o_custkey", "at").agg(F.max("o_orderkey").alias("o_orderkey"))
    right = right.withColumnRenamed("o_custkey", "user_id")
    left = _events(spark, base).select("event_id", "user_id", "ts")
    return sessions.as_of_join(left, right, "user_id", "ts", "at", ["o_orderkey"]).select("event_id", "o_orderkey")


@query("""
WITH r AS (SELECT o_custkey, o_orderdate + INTERVAL 24 YEAR AS at, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2)
SELECT event_id, r.o_orderkey FROM events e ASOF LEFT JOIN r ON e.user_id = r.o_custkey AND e.ts >= r.at
""")
def asof_join_spans(spark: SparkSession, base: str) -> DataFrame:
    """The as-of join with keys cut into spans of a week."""
    orders = table(spark, base, "orders").withColumn("at", F.expr("o_orderdate + interval 24 year"))
    right = orders.groupBy("o_custkey", "at").agg(F.max("o_orderkey").alias("o_orderkey"))
    right = right.withColumnRenamed("o_custkey", "user_id")
    left = _events(spark, base).select("event_id", "user_id", "ts")
    out = sessions.as_of_join(left, right, "user_id", "ts", "at", ["o_orderkey"], span_seconds=604_800)
    return out.select("event_id", "o_orderkey")


@query(f"WITH {_SESSIONS} SELECT user_id, event_id, session FROM s")
def session_spans(spark: SparkSession, base: str) -> DataFrame:
    """Sessions of keys that are cut into spans of a day."""
    rows = _events(spark, base).select("user_id", "event_id", "ts")
    return sessions.gap_sessions(rows, "user_id", "ts", "event_id", 21600, span_seconds=86_400).drop("ts")


@query("""
WITH l AS (SELECT user_id, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old, event_type AS new FROM events)
SELECT * FROM l WHERE old IS NOT NULL AND old <> new
""")
def foreground_changes(spark: SparkSession, base: str) -> DataFrame:
    return sessions.changes(_events(spark, base), "user_id", "ts", "event_id", "event_type").drop("ts")


# --- hotness and memory --------------------------------------------------------------------------

_HOT = f"""
a AS (SELECT user_id, greatest((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 1e6, 0)::DOUBLE AS age,
        CASE event_type WHEN 'purchase' THEN 3.0::DOUBLE WHEN 'click' THEN 2.0 ELSE 1.0 END AS w FROM events),
h AS (SELECT user_id, round(sum(w * pow(2.0, -age / 3600)) * 0.4 + sum(w * pow(2.0, -age / 21600)) * 0.3
        + sum(w * pow(2.0, -age / 86400)) * 0.2 + sum(w * pow(2.0, -age / 604800)) * 0.1, 6)::DOUBLE AS score FROM a GROUP BY 1)
"""
_BIN = "CASE WHEN score >= 0.75 THEN 'hot' WHEN score >= 0.5 THEN 'recent' WHEN score >= 0.25 THEN 'warm' WHEN score >= 0.1 THEN 'cool' ELSE 'cold' END"


def _hotness(spark: SparkSession, base: str) -> DataFrame:
    weight = F.when(F.col("event_type") == "purchase", 3.0).when(F.col("event_type") == "click", 2.0).otherwise(1.0)
    return memory.hotness(_events(spark, base), "user_id", "ts", weight, _now())


@query(f"WITH {_HOT} SELECT user_id, score, rank() OVER (ORDER BY score DESC)::INT AS rank FROM h")
def hotness_rank(spark: SparkSession, base: str) -> DataFrame:
    ranked = ordered.rank_over_all(_hotness(spark, base), "score")
    return ranked.select("user_id", "score", F.col("rank").cast("int").alias("rank"))


@query(f"WITH {_HOT} SELECT {_BIN} AS bin, count(*) AS n FROM h GROUP BY 1")
def hotness_bins(spark: SparkSession, base: str) -> DataFrame:
    return _hotness(spark, base).groupBy(memory.bin_of(F.col("score")).alias("bin")).agg(F.count("*").alias("n"))


@query(f"""
WITH {_HOT}, b AS (SELECT user_id, score / 4 AS score FROM h), c AS (SELECT *, {_BIN} AS bin FROM b),
n AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY score DESC, user_id) AS n FROM c WHERE bin <> 'cold'),
q AS (SELECT *, CASE bin WHEN 'hot' THEN 9 WHEN 'recent' THEN 6 WHEN 'warm' THEN 4 ELSE 2 END AS quota,
        CASE bin WHEN 'hot' THEN 0 WHEN 'recent' THEN 1 WHEN 'warm' THEN 2 ELSE 3 END AS place FROM n),
o AS (SELECT *, row_number() OVER (ORDER BY n > quota, CASE WHEN n <= quota THEN place END NULLS FIRST, score DESC, user_id)::INT AS position FROM q)
SELECT user_id, score, bin, position FROM o WHERE position <= 21
""")
def hotness_select(spark: SparkSession, base: str) -> DataFrame:
    return memory.select_hot(_hotness(spark, base).withColumn("score", F.col("score") / 4), 21, "user_id")


@query("""
WITH RECURSIVE d AS (SELECT user_id, event_id, epoch_us(ts) AS tm, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, event_id, n, tm AS last, true AS accepted FROM d WHERE n = 1
  UNION ALL SELECT d.user_id, d.event_id, d.n, CASE WHEN d.tm - f.last >= 3600000000 THEN d.tm ELSE f.last END, d.tm - f.last >= 3600000000
  FROM f JOIN d ON d.user_id = f.user_id AND d.n = f.n + 1)
SELECT event_id, accepted FROM f
""")
def hotness_rate_limit(spark: SparkSession, base: str) -> DataFrame:
    """Touches accepted by the rate limit; each hangs on the one accepted before."""
    rows = _events(spark, base).select("user_id", "event_id", "ts")
    return memory.rate_limited(rows, ["user_id"], "ts", 3600, "event_id", span_seconds=7 * 86_400).select("event_id", "accepted")


_MEMORY = f"""
c AS (SELECT d.doc_id, coalesce(e.s, 0) AS semantic, coalesce(b.bm25, 0) AS keyword, (d.doc_id % 3) / 2.0::DOUBLE AS graph,
        (d.doc_id % 10) / 10.0::DOUBLE AS importance, (d.doc_id % 4) / 4.0::DOUBLE AS trust,
        TIMESTAMP '2024-01-01' + to_minutes(d.doc_id) AS created, d.n_chars FROM documents d
      LEFT JOIN (SELECT doc_id, round(bm25, 6) AS bm25 FROM ({_bm25_sql(TERMS)})) b USING (doc_id)
      LEFT JOIN (SELECT vec_id AS doc_id, abs(embedding[1])::DOUBLE AS s FROM embeddings) e USING (doc_id)),
m AS (SELECT *, round(0.45 * semantic / max(semantic) OVER () + 0.25 * CASE WHEN max(keyword) OVER () > 0 THEN keyword / max(keyword) OVER () ELSE 0 END
        + 0.10 * graph / max(graph) OVER () + 0.10 * pow(2.0, -greatest((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(created)) / 1e6, 0) / 86400 / 90)
        + 0.05 * importance + 0.05 * trust, 6)::DOUBLE AS score FROM c)
"""


def _memories(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents").select("doc_id", "n_chars")
    key = _bm25(spark, base).select("doc_id", F.round("bm25", 6).alias("bm25"))
    sem = table(spark, base, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.abs(F.get("embedding", F.lit(0))).cast("double").alias("s")
    )
    rows = docs.join(key, "doc_id", "left").join(sem, "doc_id", "left")
    parts = rows.select(
        "doc_id", "n_chars", F.coalesce("s", F.lit(0.0)).alias("semantic"), F.coalesce("bm25", F.lit(0.0)).alias("keyword"),
        (F.col("doc_id") % 3 / 2.0).alias("graph"), (F.col("doc_id") % 10 / 10.0).alias("importance"),
        (F.col("doc_id") % 4 / 4.0).alias("trust"),
        F.timestamp_micros(F.lit(1704067200000000) + F.col("doc_id") * 60_000_000).alias("created"),
    )
    return memory.rank_memories(parts, _now(), "doc_id", "created")


@query(f"WITH {_MEMORY} SELECT doc_id, score FROM m")
def memory_rank(spark: SparkSession, base: str) -> DataFrame:
    return _memories(spark, base).select("doc_id", "score")


@query(f"""
WITH {_MEMORY}, k AS (SELECT *, (['decision', 'procedure', 'fact', 'episodic', 'glossary'])[doc_id % 5 + 1] AS kind,
  greatest(1, ceil(n_chars / 4.0))::BIGINT AS tokens FROM m),
n AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, doc_id) AS n FROM k QUALIFY n <= 2),
o AS (SELECT *, row_number() OVER w AS position, sum(tokens) OVER w AS upto FROM n WINDOW w AS (ORDER BY score DESC, doc_id % 5, doc_id))
SELECT doc_id, position::INT AS position, tokens FROM o WHERE upto <= 6000 AND position <= 8
""")
def pack_budget(spark: SparkSession, base: str) -> DataFrame:
    kinds = F.array(*map(F.lit, memory.TYPE_ORDER))
    rows = _memories(spark, base).withColumn("kind", F.get(kinds, (F.col("doc_id") % 5).cast("int")))
    rows = rows.withColumn("tokens", F.greatest(F.lit(1), F.ceil(F.col("n_chars") / 4)).cast("long"))
    return memory.pack(rows, "doc_id", "kind", "tokens", budget=6000)


@query(f"""
WITH h AS (SELECT doc_id, round(bm25 / (1 + bm25), 6) AS lexical FROM ({_bm25_sql(TERMS)})),
j AS (SELECT h.*, sha256(text) AS sha, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS seen FROM h JOIN documents USING (doc_id)),
s AS (SELECT *, round(0.85 * lexical + 0.15 * pow(2.0, -((epoch_us(max(seen) OVER ()) - epoch_us(seen)) / 1e6 / 86400) / 30), 6)::DOUBLE AS score FROM j),
u AS (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY score DESC, doc_id) AS n FROM s)
SELECT doc_id, score FROM u WHERE n = 1 ORDER BY score DESC, doc_id LIMIT 24
""")
def memory_span_query(spark: SparkSession, base: str) -> DataFrame:
    hits = _bm25(spark, base).select("doc_id", F.round(scoring.lexical_score(F.col("bm25")), 6).alias("lexical"))
    docs = table(spark, base, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    at = F.timestamp_micros(F.lit(1704067200000000) + F.col("doc_id") * 60_000_000)
    rows = hits.join(docs, "doc_id").withColumn("at", at)
    return memory.span_query(rows, "at", "doc_id", "sha", k=24).select("doc_id", "score")


@query(f"""
SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderkey % 3 <= 1
  AND (o_orderdate + INTERVAL 24 YEAR <= TIMESTAMP '{AS_OF}') AND (o_orderkey % 4 = 0 OR o_orderdate + INTERVAL 25 YEAR > TIMESTAMP '{AS_OF}')
  AND o_orderpriority IN ('1-URGENT', '2-HIGH')
""")
def memory_policy_filter(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 3).alias("sensitivity"),
        F.expr("o_orderdate + interval 24 year").alias("valid_from"),
        F.when(F.col("o_orderkey") % 4 != 0, F.expr("o_orderdate + interval 25 year")).alias("valid_to"),
        F.array("o_orderpriority").alias("audiences"),
    )
    return memory.policy_filter(rows, _now(), ["F", "O"], 1, ["1-URGENT", "2-HIGH"]).select("o_orderkey")


_EDGES = """
e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'holds' AS relation, n_nationkey % 3 AS weight FROM nation
  UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'serves', s_suppkey % 7 FROM supplier
  UNION ALL SELECT 's' || s_suppkey, 'n' || ((s_nationkey + 1) % 25), 'also', s_suppkey % 5 FROM supplier)
"""


def _edges(spark: SparkSession, base: str) -> DataFrame:
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c) if isinstance(c, str) else c)
    nation, supplier = table(spark, base, "nation"), table(spark, base, "supplier")
    one = nation.select(
        name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst"), F.lit("holds").alias("relation"),
        (F.col("n_nationkey") % 3).cast("long").alias("weight"),
    )
    two = supplier.select(
        name("n", "s_nationkey"), name("s", "s_suppkey"), F.lit("serves"), (F.col("s_suppkey") % 7).cast("long")
    )
    three = supplier.select(
        name("s", "s_suppkey"), name("n", (F.col("s_nationkey") + 1) % 25), F.lit("also"), (F.col("s_suppkey") % 5).cast("long")
    )
    return one.union(two).union(three)


@query(f"""
WITH {_EDGES}, s0 AS (SELECT 'r1' AS node, 0 AS depth),
a1 AS (SELECT dst, min((relation, -weight)) AS o FROM e JOIN s0 ON src = node WHERE dst NOT IN (SELECT node FROM s0) GROUP BY 1),
s1 AS (SELECT * FROM s0 UNION ALL SELECT dst, 1 FROM (SELECT dst, row_number() OVER (ORDER BY o, dst) AS n FROM a1) WHERE n <= greatest(20 - (SELECT count(*) FROM s0), 1)),
a2 AS (SELECT dst, min((relation, -weight)) AS o FROM e JOIN s1 ON src = node AND depth = 1 WHERE dst NOT IN (SELECT node FROM s1) AND (SELECT count(*) FROM s1) < 20 GROUP BY 1),
s2 AS (SELECT * FROM s1 UNION ALL SELECT dst, 2 FROM (SELECT dst, row_number() OVER (ORDER BY o, dst) AS n FROM a2) WHERE n <= greatest(20 - (SELECT count(*) FROM s1), 1)),
a3 AS (SELECT dst, min((relation, -weight)) AS o FROM e JOIN s2 ON src = node AND depth = 2 WHERE dst NOT IN (SELECT node FROM s2) AND (SELECT count(*) FROM s2) < 20 GROUP BY 1),
s3 AS (SELECT * FROM s2 UNION ALL SELECT dst, 3 FROM (SELECT dst, row_number() OVER (ORDER BY o, dst) AS n FROM a3) WHERE n <= greatest(20 - (SELECT count(*) FROM s2), 1))
SELECT node, depth::INT AS depth FROM s3
""")
def graph_bfs(spark: SparkSession, base: str) -> DataFrame:
    """Directed expansion in edge order, with a bound of 20 nodes (its feature)."""
    start = spark.range(1).select(F.lit("r1").alias("node"))
    return memory.expand(_edges(spark, base), start, depth=3, most=20)


@query(f"""
WITH {_EDGES}, s0 AS (SELECT 'r' || r_regionkey AS node FROM region WHERE r_name IN ('ASIA', 'EUROPE')),
s1 AS (SELECT DISTINCT dst AS node FROM e WHERE src IN (SELECT node FROM s0) AND dst NOT IN (SELECT node FROM s0)),
n AS (SELECT node FROM s0 UNION SELECT node FROM s1),
l AS (SELECT c_custkey, 'n' || c_nationkey AS entity_id FROM customer)
SELECT c_custkey, 1.0::DOUBLE AS score FROM l WHERE entity_id IN (SELECT node FROM n)
""")
def entity_linked_items(spark: SparkSession, base: str) -> DataFrame:
    """Items of what the hinted entities lead to."""
    names = table(spark, base, "region").select(
        F.concat(F.lit("r"), "r_regionkey").alias("entity_id"), F.col("r_name").alias("name"), F.lit("default").alias("namespace")
    )
    start = memory.entity_ids(names, "default", ["ASIA", "EUROPE"])
    nodes = memory.expand(_edges(spark, base), start, depth=1)
    items = table(spark, base, "customer").select("c_custkey")
    links = table(spark, base, "customer").select("c_custkey", F.concat(F.lit("n"), "c_nationkey").alias("entity_id"))
    return memory.linked_items(links, items, nodes, "c_custkey")


@query("""
WITH p AS (SELECT s_suppkey, (['hard', 'soft'])[s_suppkey % 2 + 1] AS level, (s_acctbal * 100)::BIGINT AS r FROM supplier),
n AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY r, s_suppkey) AS n FROM p)
SELECT s_suppkey, n <= CASE level WHEN 'hard' THEN 3 ELSE 5 END AS kept FROM n
""")
def pin_selection(spark: SparkSession, base: str) -> DataFrame:
    level = F.when(F.col("s_suppkey") % 2 == 0, "hard").otherwise("soft")
    pins = table(spark, base, "supplier").select(
        "s_suppkey", level.alias("pin_level"), F.round(F.col("s_acctbal") * 100).cast("long").alias("pin_rank")
    )
    return memory.select_pins(pins, {"hard": 3, "soft": 5}, "s_suppkey").select("s_suppkey", "kept")
