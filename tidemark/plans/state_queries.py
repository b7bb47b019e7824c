"""Queries: compiled contexts, job tables, changed tables, readers and sinks, extension contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import extend
from tidemark.operators import context, graph, lexical, queues, writes
from tidemark.plans.registry import query, shared_folder
from tidemark.plans.search_queries import _bm25_sql, _cosine_sql, _query_vector
from tidemark.sources import tables
from tidemark.sources.tables import table
from tidemark.streaming import aggregate

AS_OF = "2024-01-31 00:00:00"


def _now():
    return F.lit(AS_OF).cast("timestamp")


# --- contexts --------------------------------------------------------------------------------------

_BUDGET = """
h AS (SELECT page_id, html, row_number() OVER (ORDER BY page_id) AS nth FROM pages ORDER BY page_id LIMIT 30),
t AS (SELECT page_id, nth, length(html) > 300 AS truncated, left(html, 300) AS body, sum(length(left(html, 300))) OVER (ORDER BY nth) AS upto FROM h),
k AS (SELECT * FROM t WHERE upto <= 5000)
"""


def _budgeted(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "pages").select("page_id", "html", F.timestamp_seconds("page_id").alias("seen"))
    return context.within_budgets(rows, "page_id", "html", 30, 300, 5000)


@query(f"WITH {_BUDGET} SELECT page_id, truncated, upto::BIGINT AS upto, 'S' || lpad(nth::VARCHAR, 3, '0') AS cite_id FROM k")
def span_budgets(spark: SparkSession, base: str) -> DataFrame:
    return _budgeted(spark, base).select("page_id", "truncated", "upto", "cite_id")


@query(f"""
WITH {_BUDGET}, s AS (SELECT string_agg('"' || page_id || '"', ',' ORDER BY nth) AS ids, count(*) FILTER (truncated) AS n, max(upto)::BIGINT AS total FROM k),
i AS (SELECT string_agg('"' || s_suppkey || '"', ',' ORDER BY s_suppkey) AS ids FROM supplier WHERE s_suppkey <= 4)
SELECT sha256('{{"config_sha256":"c0","item_ids":[' || i.ids || '],"query":"what is open","span_ids":[' || s.ids || ']}}') AS snapshot_id, n AS truncated_spans, total AS total_chars FROM s, i
""")
def context_compile(spark: SparkSession, base: str) -> DataFrame:
    items = table(spark, base, "supplier").where("s_suppkey <= 4").select("s_suppkey", F.col("s_suppkey").alias("position"))
    out = context.compile_context(_budgeted(spark, base), items, " what is open ", "c0", "page_id", "s_suppkey")
    return out.select("snapshot_id", "truncated_spans", "total_chars")


@query(f"SELECT o_orderkey AS snapshot_id, coalesce(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(o_orderdate + INTERVAL 24 YEAR) >= 30 * 86400000000, false) AS expired FROM orders")
def snapshot_gc(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "orders").select(F.col("o_orderkey").alias("snapshot_id"), F.expr("o_orderdate + interval 24 year").alias("created"))
    return context.expired_snapshots(rows, "created", _now(), 30).select("snapshot_id", "expired")


@query("""
SELECT c_custkey AS snapshot_id, c_name AS query FROM customer WHERE c_custkey % 4 <> 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 4 = 0
""")
def snapshot_record(spark: SparkSession, base: str) -> DataFrame:
    old = table(spark, base, "customer").select(F.col("c_custkey").alias("snapshot_id"), F.col("c_name").alias("query"))
    return context.record_snapshot(old, old.where("snapshot_id % 4 = 0").withColumn("query", F.lit("new")))


@query("""
WITH RECURSIVE o AS (SELECT doc_id, 0 AS chunk, sha256('old') AS chunk_hash FROM documents WHERE doc_id % 3 <> 0), c AS (
  SELECT doc_id, text, 0 AS chunk, 0 AS s, CASE WHEN length(text) <= 800 THEN length(text) WHEN contains(substr(text, 201, 600), chr(10) || chr(10))
    THEN 800 - strpos(reverse(substr(text, 201, 600)), chr(10) || chr(10)) + 1 ELSE 800 END AS e FROM documents WHERE length(text) > 0 AND doc_id % 3 = 0
  UNION ALL SELECT doc_id, text, chunk + 1, e, CASE WHEN length(text) <= e + 800 THEN length(text) WHEN contains(substr(text, e + 201, 600), chr(10) || chr(10))
    THEN e + 800 - strpos(reverse(substr(text, e + 201, 600)), chr(10) || chr(10)) + 1 ELSE e + 800 END FROM c WHERE e < length(text))
SELECT doc_id, chunk::INT AS chunk, chunk_hash FROM o UNION ALL SELECT doc_id, chunk::INT, sha256(substr(text, s + 1, e - s)) FROM c
""")
def document_replace(spark: SparkSession, base: str) -> DataFrame:
    """Chunks after a third of all documents were replaced: their old chunks go, those of their whole texts come."""
    docs = table(spark, base, "documents").select("doc_id", "text")
    old = docs.select("doc_id", F.lit(0).alias("chunk"), F.sha2(F.lit("old"), 256).alias("chunk_hash"))
    return context.replace_documents(old, docs.where("doc_id % 3 = 0"), "doc_id", "text")



@query("""
SELECT conv_id, turn, role FROM conversations WHERE conv_id % 5 <> 0 UNION ALL SELECT DISTINCT conv_id, -1, 'new' FROM conversations WHERE conv_id % 5 = 0
""")
def member_replace(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "conversations").select("conv_id", "turn", "role")
    new = rows.where("conv_id % 5 = 0").select("conv_id", F.lit(-1).cast("long").alias("turn"), F.lit("new").alias("role")).distinct()
    return context.replace_members(rows, new, "conv_id")


@query("""
SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND event_type <> 'view'
""")
def pins_after(spark: SparkSession, base: str) -> DataFrame:
    log = table(spark, base, "events").withColumn("pinned", F.col("event_type") != "view")
    return context.pins_after(log, "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text || chr(10) || chr(10) || 'layout ' || doc_id ELSE source END AS body, CASE WHEN doc_id % 3 = 0 THEN lang END AS agent FROM documents
""")
def index_upsert(spark: SparkSession, base: str) -> DataFrame:
    """An index's texts after half of them came anew; agent texts stay."""
    docs = table(spark, base, "documents")
    old = docs.select("doc_id", F.col("source").alias("body"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("agent"))
    body = lexical.index_text(F.col("text"), F.lit(" "), F.concat(F.lit("layout "), "doc_id"), F.lit(None).cast("string"))
    new = docs.where("doc_id % 2 = 0").select("doc_id", body.alias("body"), F.lit(None).cast("string").alias("agent"))
    return lexical.upsert_text(old, new, "doc_id")


# --- jobs ----------------------------------------------------------------------------------------

_JOBS = """
j AS (SELECT 'j' || o_orderkey AS job_key, (['ocr', 'embed', 'agent'])[o_orderkey % 3 + 1] AS job_type, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'leased' ELSE 'completed' END AS status,
  o_orderkey % 5 AS attempts, 3 AS max_attempts, o_orderdate + INTERVAL 24 YEAR AS scheduled_for, o_orderdate AS created_at, o_orderdate + INTERVAL 25 YEAR AS lease_expires_at FROM orders)
"""


def _jobs(spark: SparkSession, base: str) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, ["ocr", "embed", "agent"])), (F.col("o_orderkey") % 3).cast("int"))
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "leased").otherwise("completed")
    return table(spark, base, "orders").select(
        F.concat(F.lit("j"), "o_orderkey").alias("job_key"), kind.alias("job_type"), status.alias("status"),
        (F.col("o_orderkey") % 5).cast("int").alias("attempts"), F.lit(3).alias("max_attempts"),
        F.expr("o_orderdate + interval 24 year").alias("scheduled_for"), F.col("o_orderdate").alias("created_at"),
        F.expr("o_orderdate + interval 25 year").alias("lease_expires_at"), F.lit(None).cast("string").alias("leased_by"),
        F.lit(None).cast("string").alias("last_error"),
    )


@query(f"""
WITH {_JOBS}, t AS (SELECT job_key FROM j WHERE status = 'pending' AND scheduled_for <= TIMESTAMP '{AS_OF}' AND attempts < max_attempts AND job_type IN ('ocr', 'agent')
  ORDER BY scheduled_for, created_at, job_key LIMIT 5)
SELECT job_key, CASE WHEN job_key IN (SELECT job_key FROM t) THEN 'leased' ELSE status END AS status, (attempts + (job_key IN (SELECT job_key FROM t))::INT)::INT AS attempts,
  CASE WHEN job_key IN (SELECT job_key FROM t) THEN 'w1' END AS leased_by,
  CASE WHEN job_key IN (SELECT job_key FROM t) THEN epoch_us(TIMESTAMP '{AS_OF}') + 30000000 ELSE epoch_us(lease_expires_at) END AS until_us FROM j
""")
def job_lease(spark: SparkSession, base: str) -> DataFrame:
    out = queues.lease(_jobs(spark, base), _now(), "w1", 30, 5, ["ocr", "agent"])
    return out.select("job_key", "status", "attempts", "leased_by", F.unix_micros("lease_expires_at").alias("until_us"))


@query(f"""
WITH {_JOBS} SELECT job_key, CASE WHEN status = 'leased' AND lease_expires_at < TIMESTAMP '{AS_OF}' THEN CASE WHEN attempts < max_attempts THEN 'pending' ELSE 'failed' END ELSE status END AS status FROM j
""")
def job_recovery(spark: SparkSession, base: str) -> DataFrame:
    return queues.recover_stale(_jobs(spark, base), _now()).select("job_key", "status")


@query(f"""
WITH {_JOBS}, f AS (SELECT job_key FROM j WHERE job_type = 'embed')
SELECT job_key, CASE WHEN job_key NOT IN (SELECT job_key FROM f) THEN status WHEN attempts < max_attempts THEN 'pending' ELSE 'failed' END AS status,
  CASE WHEN job_key IN (SELECT job_key FROM f) AND attempts < max_attempts THEN epoch_us(TIMESTAMP '{AS_OF}') + 60000000 ELSE epoch_us(scheduled_for) END AS due_us,
  CASE WHEN job_key IN (SELECT job_key FROM f) THEN 'late' END AS last_error FROM j
""")
def job_failures(spark: SparkSession, base: str) -> DataFrame:
    jobs = _jobs(spark, base)
    failed = jobs.where("job_type = 'embed'").select("job_key", F.lit("late").alias("error"))
    return queues.fail(jobs, failed, _now(), 60).select("job_key", "status", F.unix_micros("scheduled_for").alias("due_us"), "last_error")


@query(f"""
WITH {_JOBS}, n AS (SELECT DISTINCT 'j' || l_orderkey * 2 AS job_key FROM lineitem), f AS (SELECT job_key, row_number() OVER (ORDER BY job_key) AS n FROM n WHERE job_key NOT IN (SELECT job_key FROM j))
SELECT job_key, status FROM j UNION ALL SELECT job_key, 'pending' FROM f WHERE n <= (SELECT count(*) FROM j WHERE status = 'pending') + 25 - (SELECT count(*) FROM j WHERE status = 'pending')
""")
def job_enqueue(spark: SparkSession, base: str) -> DataFrame:
    """New jobs fill the backlog's room, which is 25 more than is pending here."""
    jobs = _jobs(spark, base)
    pending = jobs.where("status = 'pending'").count()
    new = table(spark, base, "lineitem").select(F.concat(F.lit("j"), F.col("l_orderkey") * 2).alias("job_key"))
    return queues.enqueue(jobs, new, "job_key", "job_key", pending + 25).select("job_key", "status")


# --- readers and sinks -----------------------------------------------------------------------------


@query(f"""
SELECT event_id, count(*) OVER () AS events, epoch_us(min(ts) OVER ()) AS first_us FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY
""")
def exported_events(spark: SparkSession, base: str) -> DataFrame:
    """Events of the last days, written as JSON lines with a manifest, and read again."""
    folder = shared_folder(spark, "export")
    manifest = tables.export_jsonl(table(spark, base, "events"), f"{folder}/events", AS_OF, 10)
    back = spark.read.json(f"{folder}/events").select("event_id")
    return back.join(F.broadcast(manifest)).select("event_id", "events", F.unix_micros("first").alias("first_us"))


@query("SELECT 'c' || item_id AS id, item_id % 2 = 0 AS expected_no_evidence, 'E' || item_id AS first FROM benchmark")
def eval_case_reader(spark: SparkSession, base: str) -> DataFrame:
    folder = shared_folder(spark, "cases")
    cases = table(spark, base, "benchmark").select(
        F.concat(F.lit("c"), "item_id").alias("id"), F.col("text").alias("query"),
        F.array(F.concat(F.lit("E"), "item_id")).alias("expected_evidence_ids"), (F.col("item_id") % 2 == 0).alias("expected_no_evidence"),
    )
    cases.write.json(folder)
    back = tables.eval_cases(spark, folder)
    return back.select("id", "expected_no_evidence", F.get("expected_evidence_ids", F.lit(0)).alias("first"))


@query("SELECT value AS ms FROM events")
def timing_reader(spark: SparkSession, base: str) -> DataFrame:
    """The last field of each line; blank lines, comments and lines without a number are none."""
    folder = shared_folder(spark, "timings")
    lines = table(spark, base, "events").select(
        F.concat(F.lit("x\t"), "event_type", F.lit(", "), F.col("value").cast("string"), F.lit("\n# 7\n\nnone")).alias("value")
    )
    lines.write.text(folder)
    return tables.timings(spark, folder)


@query("""
SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, event_type AS event, CASE WHEN event_type = 'view' THEN NULL ELSE value END AS value FROM events WHERE user_id % 2 = 0 ORDER BY 1 DESC LIMIT 40
""")
def perf_log_tail(spark: SparkSession, base: str) -> DataFrame:
    folder = shared_folder(spark, "perf")
    rows = table(spark, base, "events").select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), F.concat(F.lit("u"), F.col("user_id") % 2).alias("component"),
        F.col("event_type").alias("event"), F.when(F.col("event_type") != "view", F.col("value")).alias("value"),
    )
    tables.append_log(rows, folder)
    return tables.perf_log(spark, folder, "u0", 40).select("ts", "event", "value")


@query("SELECT 3 AS logs, count(*) AS n FROM events")
def log_rotation(spark: SparkSession, base: str) -> DataFrame:
    """A log that begins anew at each append, of which the newest three folders stay."""
    folder = shared_folder(spark, "rotate")
    rows = table(spark, base, "events").select("event_id")
    for n in range(5):
        tables.append_log(rows if n == 3 else rows.limit(1), folder, 1, 3)
    logs = spark.read.json(folder)
    whole = logs.where("log = 3").agg(F.count("*").alias("n"))
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    found = names.select(F.regexp_extract("path", "log=([0-9]+)", 1).alias("log")).distinct().agg(F.count("*").cast("int").alias("logs"))
    return found.join(F.broadcast(whole))


@query("SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1")
def idempotent_append(spark: SparkSession, base: str) -> DataFrame:
    """A batch that is written twice: its keys are there once."""
    folder = shared_folder(spark, "append")
    rows = table(spark, base, "events").select("user_id", "event_type", "event_id")
    for _ in range(2):
        tables.append_new(rows, folder, ["user_id", "event_type"])
    return spark.read.parquet(folder).groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*) AS n, 2 AS reports FROM events GROUP BY 1")
def report_sinks(spark: SparkSession, base: str) -> DataFrame:
    folder = shared_folder(spark, "report")
    rows = table(spark, base, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    for _ in range(2):
        tables.write_report(rows, f"{folder}/last")
        tables.append_report(rows, f"{folder}/all")
    every = spark.read.json(f"{folder}/all").groupBy("user_id").agg(F.count("*").cast("int").alias("reports"))
    return spark.read.json(f"{folder}/last").join(every, "user_id").select("user_id", "n", "reports")


@query("SELECT sum(length(event_id::VARCHAR) + 1)::BIGINT AS bytes FROM events")
def folder_bytes(spark: SparkSession, base: str) -> DataFrame:
    """The size of a folder whose files hold one line for each event."""
    folder = shared_folder(spark, "lines")
    table(spark, base, "events").select(F.col("event_id").cast("string")).write.text(folder)
    return tables.folder_size(spark, folder)



@query("SELECT doc_id, count(*) OVER () AS n FROM documents")
def resumed_backfill(spark: SparkSession, base: str) -> DataFrame:
    """A table gone through in slices, by one run that ends early and one that goes on after its mark."""
    folder = shared_folder(spark, "backfill")
    rows = table(spark, base, "documents").select("doc_id")

    def sink(part: DataFrame, first: str, last: str) -> None:
        part.write.mode("overwrite").parquet(f"{folder}/out/slice={first}")

    size = max(1, rows.count() // 5)
    for most in (2, None):
        aggregate.backfill(rows, "doc_id", size, sink, f"{folder}/mark", most)
    back = spark.read.parquet(f"{folder}/out").select("doc_id")
    return back.join(F.broadcast(back.agg(F.count("*").alias("n"))))


@query("SELECT event_id, (SELECT count(*) - 100 FROM events) AS dropped FROM events ORDER BY event_id LIMIT 100")
def bounded_queue(spark: SparkSession, base: str) -> DataFrame:
    kept, dropped = aggregate.bounded_batch(table(spark, base, "events").select("event_id"), 100, "event_id")
    return kept.join(F.broadcast(dropped))


# --- contracts -------------------------------------------------------------------------------------


@query("SELECT doc_id, length(text)::DOUBLE AS n, (length(text) % 7)::DOUBLE AS r FROM documents")
def encoder_contract(spark: SparkSession, base: str) -> DataFrame:
    encode = extend.text_encoder(lambda texts: [[float(len(x)), 1.0] for x in texts], 2)
    rows = table(spark, base, "documents").select("doc_id", encode(F.col("text")).alias("v"))
    return rows.select("doc_id", F.get("v", F.lit(0)).cast("double").alias("n"), (F.get("v", F.lit(0)) % 7).cast("double").alias("r"))


@query("SELECT doc_id, (length(text) + 7)::DOUBLE AS score FROM documents")
def reranker_contract(spark: SparkSession, base: str) -> DataFrame:
    score = extend.reranker(lambda q, docs: [len(q) + len(d) for d in docs], "license")
    return table(spark, base, "documents").select("doc_id", score(F.col("text")).alias("score"))


@query(f"""
SELECT vec_id, round({_cosine_sql()}, 6) AS score FROM embeddings WHERE vec_id % 3 <> 0 OR vec_id % 2 = 0 ORDER BY score DESC, vec_id LIMIT 15
""")
def store_contract(spark: SparkSession, base: str) -> DataFrame:
    """A store from which a third was deleted, and into which half of all rows was put again."""
    rows = table(spark, base, "embeddings").select("vec_id", "embedding")
    store = extend.VectorStore(rows, "vec_id", "embedding")
    store = store.delete(rows.where("vec_id % 3 = 0")).upsert(rows.where("vec_id % 2 = 0"))
    return store.search(_query_vector(spark, base), 15)


class _Bm25:
    def __init__(self, docs: DataFrame):
        self.docs = docs

    def retrieve(self, query: str, limit: int) -> DataFrame:
        hits = lexical.bm25(self.docs, lexical.query_tokens(query), "doc_id", "text")
        return hits.select("doc_id", F.round("bm25", 6).alias("score"))


class _Longest:
    def __init__(self, docs: DataFrame):
        self.docs = docs

    def retrieve(self, query: str, limit: int) -> DataFrame:
        return self.docs.select("doc_id", F.col("n_chars").cast("double").alias("score"))


@query(f"""
SELECT doc_id, 'bm25' AS strategy, row_number() OVER (ORDER BY round(bm25, 6) DESC, doc_id)::INT AS rank FROM ({_bm25_sql(('license', 'moron'))}) QUALIFY rank <= 10
UNION ALL (SELECT doc_id, 'longest', row_number() OVER (ORDER BY n_chars DESC, doc_id)::INT AS rank FROM documents QUALIFY rank <= 10)
""")
def strategy_contract(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents")
    return extend.run_strategies({"bm25": _Bm25(docs), "longest": _Longest(docs)}, "the license, a moron", 10, "doc_id")


@query("""
SELECT event_id, k FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (props->>'k')::BIGINT END AS k FROM events)
""")
def extractor_contract(spark: SparkSession, base: str) -> DataFrame:
    import json

    def extract(row: dict):
        yield {"event_id": row["event_id"], "k": "none" if row["event_id"] % 5 == 0 else json.loads(row["props"])["k"]}

    rows = table(spark, base, "events").select("event_id", "props")
    return extend.table_extractor(rows, {"event_id": "integer", "k": "integer"}, extract)


@query("""
SELECT conv_id, string_agg(text || ' [E' || turn || role || ']', chr(10) ORDER BY turn, 'E' || turn || role, text) AS answer, count(*)::INT AS n FROM conversations GROUP BY 1
""")
def compressor_contract(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "conversations").withColumn("evidence_id", F.concat(F.lit("E"), "turn", "role"))
    out = extend.compressor(rows, "conv_id", "turn", "text", extend.extractive)
    return out.select("conv_id", "answer", F.size("citations").alias("n"))


@query("""
SELECT * FROM ((SELECT doc_id::VARCHAR AS event_id, 'long' AS source FROM documents ORDER BY n_chars DESC, doc_id LIMIT 6) UNION ALL (SELECT doc_id::VARCHAR, 'short' FROM documents ORDER BY n_chars, doc_id LIMIT 3))
""")
def adapter_hits(spark: SparkSession, base: str) -> DataFrame:
    """Hits of adapters with their own bounds; one that always fails adds nothing."""
    docs = table(spark, base, "documents")

    def ask(*order):
        hits = docs.select(F.col("doc_id").cast("string").alias("event_id"), F.lit(1.0).alias("score"), F.lit("").alias("snippet"), "n_chars", "doc_id")
        return lambda query, n: hits.orderBy(*order).limit(n)

    def broken(query, n):
        raise TimeoutError

    sources = [("long", ask(F.desc("n_chars"), "doc_id"), 6), ("broken", broken, 9), ("short", ask("n_chars", "doc_id"), 3)]
    return graph.adapters(sources, "q", 10).select("event_id", "source")


@query("""
SELECT user_id, max(epoch_us(ts)) AS last_us FROM events GROUP BY 1
""")
def ingest_batches(spark: SparkSession, base: str) -> DataFrame:
    """Items after their events came in two batches, the first one twice: each batch is merged by its newest row."""
    rows = table(spark, base, "events").select("user_id", "ts", "event_id")
    items = rows.where("false")
    for part in (rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1")):
        newest = writes.keep_newest(part, "user_id", 1, F.desc("ts"), F.desc("event_id"))
        items = writes.latest_wins(items, newest, ["user_id"], F.desc("ts"))
    return items.select("user_id", F.unix_micros("ts").alias("last_us"))
