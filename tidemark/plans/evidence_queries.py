"""Queries: span choice, decoration, fusion of results, evidence, answers, thread and graph retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import structured, text
from tidemark.operators import evidence, graph, lexical, memory, planner, search, sessions
from tidemark.plans.registry import query
from tidemark.plans.search_queries import _LISTS, TERMS, _bm25, _bm25_sql, _lists
from tidemark.sources.tables import table

# --- spans -------------------------------------------------------------------------------------


@query("""
SELECT l_orderkey, max(l_extendedprice) AS score, array_to_string(list_sort(list(DISTINCT l_linenumber::VARCHAR)), ',') AS span_keys
FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1
""")
def span_best(spark: SparkSession, base: str) -> DataFrame:
    hits = table(spark, base, "lineitem").where("l_returnflag = 'R'")
    hits = hits.select("l_orderkey", F.col("l_linenumber").cast("string").alias("key"), "l_extendedprice")
    out = evidence.best_of_spans(hits, "l_orderkey", "key", "l_extendedprice")
    return out.withColumn("span_keys", F.array_join("span_keys", ","))


@query("""
SELECT o_orderkey, coalesce(s, '') AS spans, coalesce(n, 0)::INT AS n FROM orders LEFT JOIN (
  SELECT l_orderkey, string_agg(epoch_us(l_shipdate) || ':' || l_linenumber, ',' ORDER BY l_shipdate, l_linenumber) AS s, count(*) AS n
  FROM lineitem WHERE l_linenumber <> 2 GROUP BY 1) ON l_orderkey = o_orderkey
""")
def event_spans(spark: SparkSession, base: str) -> DataFrame:
    spans = table(spark, base, "lineitem").where("l_linenumber <> 2").withColumnRenamed("l_orderkey", "o_orderkey")
    events = table(spark, base, "orders").select("o_orderkey")
    out = evidence.with_spans(events, spans, "o_orderkey", "l_shipdate", "l_linenumber")
    shown = F.transform("spans", lambda s: F.concat(F.unix_micros(s["start"]), F.lit(":"), s["span_key"]))
    return out.select("o_orderkey", F.array_join(shown, ",").alias("spans"), F.size("spans").alias("n"))


_SPANS = """
s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
c AS (SELECT doc_id, min(i) FILTER (doc_id % 4 = 0 AND i = 3) AS by_key, min(i) FILTER (contains(lower(line), 'license')) AS by_text, min(i) AS first FROM s GROUP BY 1),
p AS (SELECT doc_id, coalesce(by_key, by_text, first) AS i FROM c)
"""


def _spans(spark: SparkSession, base: str) -> DataFrame:
    """Documents with their lines as spans; every third line has no box."""
    lines = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.struct(
            (i + 1).alias("start"), F.concat(F.lit("S"), i + 1).alias("span_key"), x.alias("text"),
            F.when((i + 1) % 3 != 0, F.array(i, F.lit(0), F.lit(10), F.lit(10))).alias("bbox"),
        ),
    )
    matched = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("S3"))).otherwise(F.array().cast("array<string>"))
    return table(spark, base, "documents").select("doc_id", "text", lines.alias("spans"), matched.alias("span_keys"))


@query(f"WITH {_SPANS} SELECT doc_id, 'S' || i AS span_key FROM p")
def span_pick(spark: SparkSession, base: str) -> DataFrame:
    span = evidence.pick_span(F.col("spans"), F.col("span_keys"), " License ")
    return _spans(spark, base).select("doc_id", span["span_key"].alias("span_key"))


@query(f"""
WITH {_SPANS}, l AS (SELECT doc_id, text, instr(lower(text), 'license') AS pos FROM documents)
SELECT doc_id, md5(CASE WHEN pos > 0 THEN substr(text, greatest(pos - 1 - 200, 0) + 1, least(pos - 1 + 7 + 200, length(text)) - greatest(pos - 1 - 200, 0)) ELSE substr(text, 1, 400) END) AS snippet,
  CASE WHEN pos > 0 THEN greatest(pos - 1 - 200, 0) ELSE 0 END::BIGINT AS snippet_offset, 'S' || i AS span_key, i % 3 = 0 AS non_citable
FROM l JOIN p USING (doc_id) WHERE length(text) > 0
""")
def decorated_results(spark: SparkSession, base: str) -> DataFrame:
    rows = evidence.decorate(_spans(spark, base).where("length(text) > 0"), F.col("text"), "license")
    return rows.select("doc_id", F.md5("snippet").alias("snippet"), "snippet_offset", "span_key", "non_citable")


@query("""
WITH s AS (SELECT page_id, [page_id % 7, page_id % 5, page_id % 7 + 4, page_id % 5 + 3] AS a FROM pages)
SELECT page_id, a[1] < 8 AND 5 < a[3] AND a[2] < 6 AND 3 < a[4] AS overlap FROM s
""")
def box_overlap(spark: SparkSession, base: str) -> DataFrame:
    x, y = F.col("page_id") % 7, F.col("page_id") % 5
    a = structured.box(F.array(x, y, x + 4, y + 3))
    b = structured.box(F.array(*map(F.lit, [8, 6, 5, 3])))
    return table(spark, base, "pages").select("page_id", structured.overlaps(a, b).alias("overlap"))


# --- fusion ------------------------------------------------------------------------------------


@query(f"""
WITH {_LISTS}, u AS (SELECT doc_id, rank, 'hybrid' AS engine, 'a' || rank % 2 AS k, 1.0::DOUBLE / rank AS lexical, 0.0::DOUBLE AS dense FROM a
  UNION ALL SELECT doc_id, rank, 'rewrite', 'b', 0, 1.0::DOUBLE / rank FROM b UNION ALL SELECT doc_id, rank, 'graph:threads', 'c', 0, 0 FROM c)
SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(rank)::INT AS best_rank, bool_and(starts_with(engine, 'graph')) AS all_graph,
  CASE WHEN bool_and(starts_with(engine, 'graph')) AND count(*) = 1 THEN min(engine) ELSE 'fusion' END AS engine,
  array_to_string(list_sort(list(DISTINCT k)), ',') AS span_keys, round(max(lexical), 6) AS lexical, round(max(dense), 6) AS dense FROM u GROUP BY 1
""")
def fuse_results(spark: SparkSession, base: str) -> DataFrame:
    a, b, c = _lists(spark, base)
    keys = lambda k: F.array(k).alias("span_keys")
    lists = [
        a.select("doc_id", "rank", F.lit("hybrid").alias("engine"), keys(F.concat(F.lit("a"), F.col("rank") % 2)), (1 / F.col("rank")).alias("lexical")),
        b.select("doc_id", "rank", F.lit("rewrite").alias("engine"), keys(F.lit("b")), (1 / F.col("rank")).alias("dense")),
        c.select("doc_id", "rank", F.lit("graph:threads").alias("engine"), keys(F.lit("c"))),
    ]
    out = evidence.fuse_results(lists, "doc_id")
    return out.select(
        "doc_id", "score", "best_rank", "all_graph", "engine", F.array_join("span_keys", ",").alias("span_keys"),
        F.round("lexical", 6).alias("lexical"), F.round("dense", 6).alias("dense"),
    )


@query(f"""
WITH {_LISTS} SELECT doc_id, 'hybrid' AS engine, rank::INT AS rank FROM a UNION ALL SELECT doc_id, 'graph', rank::INT FROM c WHERE doc_id NOT IN (SELECT doc_id FROM a)
""")
def graph_merge(spark: SparkSession, base: str) -> DataFrame:
    a, _, c = _lists(spark, base)
    primary, more = (x.select("doc_id", F.lit(n).alias("engine"), "rank") for x, n in ((a, "hybrid"), (c, "graph")))
    return evidence.with_graph(primary, more, "doc_id")


@query(f"""
WITH h AS (SELECT doc_id, round(bm25, 6) AS bm25 FROM ({_bm25_sql(TERMS)}) ORDER BY bm25 DESC, doc_id LIMIT 30)
SELECT h.doc_id, bm25, source, vec_id IS NOT NULL AS framed, coalesce(quality, -1) AS citable FROM h JOIN documents USING (doc_id) LEFT JOIN embeddings ON vec_id = h.doc_id LEFT JOIN labels l ON l.doc_id = h.doc_id
""")
def hits_in_context(spark: SparkSession, base: str) -> DataFrame:
    """Index hits with their document, and, where they have them, frame and citable span: the hits are a limited list."""
    hits = _bm25(spark, base).select("doc_id", F.round("bm25", 6).alias("bm25")).orderBy(F.desc("bm25"), "doc_id").limit(30)
    few = F.broadcast(hits)
    docs = table(spark, base, "documents").select("doc_id", "source").join(few, "doc_id")
    frames = table(spark, base, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("framed"))
    spans = table(spark, base, "labels").select("doc_id", F.col("quality").alias("citable"))
    out = docs.join(frames, "doc_id", "left").join(spans, "doc_id", "left")
    return out.select("doc_id", "bm25", "source", F.coalesce("framed", F.lit(False)).alias("framed"), F.coalesce("citable", F.lit(-1)).alias("citable"))


@query(f"""
WITH b AS (SELECT doc_id, round(round(bm25, 12) / (1 + round(bm25, 12)), 6) AS score FROM ({_bm25_sql(('license',))})), t AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM b QUALIFY rank <= 24)
SELECT 'hit_' || sha256('{{"query_id":"q7","tier":"FAST","event":' || doc_id || ',"rank":' || rank || '}}') AS hit_id, doc_id, rank::INT AS rank, 'FAST' AS tier FROM t
""")
def tiered_run(spark: SparkSession, base: str) -> DataFrame:
    """A run of the lexical tier, with the rows that are kept of it."""
    found = planner.retrieve(table(spark, base, "documents"), "license", "doc_id", "text", planner.Budget())
    rows = found.withColumn("span_key", F.lit(None).cast("string"))
    return evidence.hit_rows(rows, F.lit("q7"), F.lit("FAST"), "doc_id").select("hit_id", "doc_id", "rank", "tier")


# --- evidence ------------------------------------------------------------------------------------

_INJECTED = "(?i)(" + "|".join(text.INJECTION_PATTERNS) + ")"
_EVIDENCE = f"""
r AS (SELECT page_id // 3 AS event, page_id, html, page_id % 4 = 0 AS non_citable, list_transform(string_split(html, chr(10)), lambda x: CASE WHEN regexp_matches(x, '{_INJECTED}') THEN '[REMOVED]' ELSE x END) AS l FROM pages),
t AS (SELECT *, array_to_string(l, chr(10)) AS clean, list_filter(string_split(html, chr(10)), lambda x: trim(x, ' ') <> '') AS f FROM r),
o AS (SELECT *, sha256(clean) AS h, round(CASE WHEN len(f) > 0 THEN len(list_filter(f, lambda x: regexp_matches(x, '{_INJECTED}')))::DOUBLE / len(f) ELSE 0 END, 6) AS risk FROM t),
u AS (SELECT *, row_number() OVER (PARTITION BY event, h ORDER BY page_id) AS nth FROM o),
e AS (SELECT *, 'E' || row_number() OVER (ORDER BY event, h) AS evidence_id FROM u WHERE nth = 1)
"""


def _evidence(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "pages").withColumn("event", F.expr("page_id div 3")).withColumn("non_citable", F.col("page_id") % 4 == 0)
    return evidence.build_evidence(rows, "event", F.col("html"), "page_id")


@query(f"WITH {_EVIDENCE} SELECT page_id, evidence_id, h AS content_hash, risk AS injection_risk, risk > 0 AS redacted, CASE WHEN non_citable THEN 'derived_summary' ELSE 'source' END AS kind FROM e")
def evidence_build(spark: SparkSession, base: str) -> DataFrame:
    return _evidence(spark, base).select(
        "page_id", "evidence_id", "content_hash", F.round("injection_risk", 6).alias("injection_risk"), "redacted", "kind"
    )


@query(f"WITH {_EVIDENCE} SELECT count(*) AS total, count(*) FILTER (NOT non_citable) AS citable, count(*) FILTER (risk > 0) AS redacted, round(max(risk), 6) AS max_risk FROM e")
def evidence_summary(spark: SparkSession, base: str) -> DataFrame:
    return evidence.evidence_summary(_evidence(spark, base))


@query(f"""
WITH {_EVIDENCE}, k AS (SELECT * FROM e ORDER BY page_id LIMIT 20)
SELECT md5(string_agg(clean || ' [' || evidence_id || ']', chr(10) ORDER BY page_id)) AS answer, string_agg(evidence_id, ',' ORDER BY page_id) AS citations FROM k
""")
def extractive_answer(spark: SparkSession, base: str) -> DataFrame:
    best = _evidence(spark, base).orderBy("page_id").limit(20)  # an answer quotes the first twenty
    out = evidence.extractive_answer(best, "text", "page_id")
    return out.select(F.md5("answer").alias("answer"), F.array_join("citations", ",").alias("citations"))


@query("""
WITH k AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS flat, 'E' || row_number() OVER (ORDER BY conv_id, turn, role, text) AS id FROM conversations),
l AS (SELECT conv_id, turn, id, lpad(turn::VARCHAR, 4, '0') || ' — ' || role || (CASE WHEN turn % 2 = 0 THEN ': t' || conv_id ELSE '' END)
  || CASE WHEN flat = '' THEN '' ELSE ' — ' || CASE WHEN length(flat) > 120 THEN left(flat, 120) || '...' ELSE flat END END || ' [' || id || ']' AS line FROM k)
SELECT md5(string_agg(line, chr(10) ORDER BY lpad(turn::VARCHAR, 4, '0'), id)) AS answer, count(*)::INT AS n FROM l
""")
def timeline_answer(spark: SparkSession, base: str) -> DataFrame:
    from pyspark.sql import Window

    nth = F.row_number().over(Window.orderBy("conv_id", "turn", "role", "text"))
    rows = table(spark, base, "conversations").select(
        F.lpad(F.col("turn").cast("string"), 4, "0").alias("ts"), "role", "text",
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit("t"), "conv_id")).alias("title"),
        F.concat(F.lit("E"), nth).alias("evidence_id"),
    )
    out = evidence.timeline_answer(rows, "ts", "role", "title", "text")
    return out.select(F.md5("answer").alias("answer"), F.size("citations").alias("n"))


@query("""
SELECT doc_id, left(concat_ws(' | ', 'app: ' || nullif(source, ''), 'title: ' || lang, 'url: ' || CASE WHEN doc_id % 3 = 0 THEN 'u' || doc_id ELSE 'host' END,
  'text: ' || nullif(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '')), 1000) AS document FROM documents
""")
def rerank_documents(spark: SparkSession, base: str) -> DataFrame:
    url = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("u"), "doc_id")).otherwise("")
    shown = evidence.rerank_document(F.col("source"), F.col("lang"), url, F.lit("host"), F.col("text"))
    return table(spark, base, "documents").select("doc_id", shown.alias("document"))


# --- what is kept of runs ------------------------------------------------------------------------


@query(f"""
WITH {_LISTS} SELECT 'hit_' || sha256('{{"query_id":"q1","tier":"FAST","event":' || doc_id || ',"rank":' || rank || '}}') AS hit_id, doc_id, rank::INT AS rank FROM c
""")
def kept_hits(spark: SparkSession, base: str) -> DataFrame:
    rows = _lists(spark, base)[2].withColumn("score", F.lit(1.0)).withColumn("span_key", F.lit("S1"))
    return evidence.hit_rows(rows, F.lit("q1"), F.lit("FAST"), "doc_id").select("hit_id", "doc_id", "rank")


@query("""
SELECT DISTINCT 'tier_plan_' || sha256('{"query_id":"q' || c_nationkey || '","plan":"FAST","skipped":"' || c_mktsegment || '"}') AS decision_id, c_nationkey FROM customer
""")
def kept_plans(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "customer").select(
        "c_nationkey", F.concat(F.lit("q"), "c_nationkey").alias("query_id"), F.lit("FAST").alias("plan"), F.col("c_mktsegment").alias("skipped")
    )
    return evidence.plan_rows(rows).select("decision_id", "c_nationkey")


_TIERS = """
h AS (SELECT DISTINCT l_suppkey AS query_id, (['FAST', 'FUSION', 'RERANK'])[l_linenumber % 3 + 1] AS tier, l_linenumber % 3 AS place, l_partkey % 9 AS span_key FROM lineitem),
c AS (SELECT * FROM h WHERE span_key % 3 <> query_id % 3), f AS (SELECT *, place = min(place) OVER (PARTITION BY query_id, span_key) AS first FROM c),
g AS (SELECT query_id, tier, count(*) AS cited, bool_or(first) AS helped FROM f GROUP BY 1, 2),
t AS (SELECT q.query_id, t.tier, coalesce(cited, 0) AS cited, coalesce(helped, false) AS helped FROM (SELECT DISTINCT query_id FROM h) q,
  (VALUES ('FAST'), ('FUSION'), ('RERANK')) t(tier) LEFT JOIN g ON g.query_id = q.query_id AND g.tier = t.tier)
"""


def _tier_help(spark: SparkSession, base: str) -> DataFrame:
    tier = F.get(F.array(*map(F.lit, evidence.TIERS)), F.col("l_linenumber") % 3)
    hits = table(spark, base, "lineitem").select(F.col("l_suppkey").alias("query_id"), tier.alias("tier"), (F.col("l_partkey") % 9).alias("span_key"))
    cited = hits.where(F.col("span_key") % 3 != F.col("query_id") % 3).select("query_id", "span_key").distinct()
    return evidence.tier_help(hits, cited)


@query(f"WITH {_TIERS} SELECT * FROM t")
def tier_help(spark: SparkSession, base: str) -> DataFrame:
    """Cited spans of each tier, and whether it found some that no tier before it had."""
    return _tier_help(spark, base)


@query(f"WITH {_TIERS} SELECT tier, count(*) AS n, round(avg(helped::INT), 6) AS help_rate, round(avg(query_id % 10), 6) AS mean_ms FROM t GROUP BY 1")
def tier_usefulness(spark: SparkSession, base: str) -> DataFrame:
    rows = _tier_help(spark, base).select("tier", F.col("helped").alias("cited"), (F.col("query_id") % 10).alias("ms"))
    return planner.tier_usefulness(rows)


# --- queries -----------------------------------------------------------------------------------

_TURN_TOKENS = "list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x))"
_STOP = "['" + "', '".join(lexical.STOP_WORDS) + "']"


@query(f"""
WITH w AS (SELECT conv_id, turn, role, {_TURN_TOKENS} AS w, list_filter({_TURN_TOKENS}, lambda x: NOT list_contains({_STOP}, x)) AS k FROM conversations)
SELECT conv_id, turn, role, array_to_string(CASE WHEN len(k) > 0 THEN k ELSE w END, ' ') AS tokens FROM w
""")
def query_tokens(spark: SparkSession, base: str) -> DataFrame:
    words = F.array_join(lexical.token_column(F.col("text")), " ")
    return table(spark, base, "conversations").select("conv_id", "turn", "role", words.alias("tokens"))


@query(f"""
SELECT conv_id, turn, role, CASE WHEN regexp_matches(text, '\\d') OR {' OR '.join(f"contains(lower(text), '{w}')" for w in lexical.TIME_WORDS)} THEN 'FACT_NUMERIC_TIMEBOUND'
  WHEN role = 'system' THEN 'FILTERED' WHEN len(regexp_extract_all(lower(text), '[a-z0-9]+')) <= 2 THEN 'SHORT' ELSE 'GENERAL' END AS kind FROM conversations
""")
def query_classes(spark: SparkSession, base: str) -> DataFrame:
    kind = lexical.query_class_column(F.col("text"), F.col("role") == "system")
    return table(spark, base, "conversations").select("conv_id", "turn", "role", kind.alias("kind"))


@query("""
SELECT unnest(['where is the invoice of A B', 'where is invoice b', 'where AND is AND invoice AND b', 'where is invoice']) AS variant
""")
def query_rewrites(spark: SparkSession, base: str) -> DataFrame:
    found = lexical.rewrites("where is the   invoice of A-B?")
    return spark.range(1).select(F.explode(F.array(*map(F.lit, found))).alias("variant"))


@query(f"""
WITH b AS (SELECT doc_id, round(bm25, 6) AS bm25 FROM ({_bm25_sql(('license', 'idiot'))})), t AS (SELECT doc_id FROM b ORDER BY bm25 DESC, doc_id LIMIT 200)
SELECT vec_id AS doc_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM t)
""")
def query_event_filter(spark: SparkSession, base: str) -> DataFrame:
    events = table(spark, base, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return lexical.of_query(events, table(spark, base, "documents"), "the License of an idiot", "doc_id", "text", 10)


@query("SELECT unnest([200, 400, 5000]) AS one, unnest([100, 100, 900]) AS two")
def candidate_caps(spark: SparkSession, base: str) -> DataFrame:
    caps = [(search.candidate_cap(k), search.candidate_cap(k, True)) for k in (5, 20, 900)]
    return spark.createDataFrame(caps, "one int, two int")


# --- threads and graphs --------------------------------------------------------------------------

_THREAD = f"""
l AS (SELECT doc_id, round(bm25 / (1 + bm25), 6) AS score FROM ({_bm25_sql(TERMS)}) ORDER BY score DESC, doc_id LIMIT 60),
d AS (SELECT vec_id AS doc_id, round(abs(embedding[1])::DOUBLE, 6) AS score FROM embeddings WHERE vec_id % 3 = 0),
c AS (SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, coalesce(l.score, 0) AS lexical_score, coalesce(d.score, 0) AS dense_score FROM l FULL JOIN d ON l.doc_id = d.doc_id),
t AS (SELECT c.doc_id, t.lang, lexical_score, dense_score, round(0.6::DOUBLE * lexical_score + 0.4::DOUBLE * dense_score, 9) AS score FROM c JOIN documents t USING (doc_id)
  WHERE n_chars > 500 ORDER BY score DESC, doc_id LIMIT 15),
s AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'good' ELSE '' END AS title, 'q' || quality AS summary FROM labels),
k AS (SELECT t.*, coalesce(nullif(s.title, ''), t.lang, '') AS title, coalesce(s.summary, '') AS summary FROM t LEFT JOIN s USING (doc_id))
"""


def _threads(spark: SparkSession, base: str) -> DataFrame:
    lex = _bm25(spark, base).select("doc_id", F.round(F.col("bm25") / (1 + F.col("bm25")), 6).alias("score"))
    lex = lex.orderBy(F.desc("score"), "doc_id").limit(60)
    dense = table(spark, base, "embeddings").where("vec_id % 3 = 0").select(
        F.col("vec_id").alias("doc_id"), F.round(F.abs(F.get("embedding", F.lit(0))).cast("double"), 6).alias("score")
    )
    threads = table(spark, base, "documents").select("doc_id", "lang", "n_chars")
    found = graph.thread_candidates(lex, dense, threads, "doc_id", 15, F.col("n_chars") > 500)
    own = table(spark, base, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, "good").otherwise("").alias("title"), F.concat(F.lit("q"), "quality").alias("summary")
    )
    return graph.with_summaries(found, own, "doc_id", "lang")


@query(f"WITH {_THREAD} SELECT doc_id, score, lexical_score, dense_score, title, summary FROM k")
def thread_retrieval(spark: SparkSession, base: str) -> DataFrame:
    return _threads(spark, base).select("doc_id", "score", "lexical_score", "dense_score", "title", "summary")


@query("SELECT user_id, 0.4::DOUBLE AS score, n FROM (SELECT user_id, max(ts) AS last, count(*) AS n FROM events GROUP BY 1) ORDER BY last DESC, user_id LIMIT 7")
def recent_threads(spark: SparkSession, base: str) -> DataFrame:
    own = table(spark, base, "events").groupBy("user_id").agg(F.max("ts").alias("last"), F.count("*").alias("n"))
    return graph.recent_threads(own, "last", "user_id", 7).select("user_id", "score", "n")


@query(f"""
WITH {_THREAD}, m AS (SELECT doc_id, unnest(range(0, 4)) AS position FROM documents), v AS (SELECT doc_id, (doc_id + position * 7) % 90 AS event_id, position FROM m),
b AS (SELECT event_id, round(greatest(score - position * 0.01::DOUBLE, 0), 9) AS score, doc_id, coalesce(nullif(summary, ''), title) AS snippet
  FROM v JOIN k USING (doc_id) WHERE event_id IN (SELECT event_id FROM events WHERE event_type <> 'view'))
SELECT event_id, score, snippet FROM b QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY score DESC, doc_id) = 1 ORDER BY score DESC, event_id LIMIT 20
""")
def thread_hits(spark: SparkSession, base: str) -> DataFrame:
    members = table(spark, base, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("position"))
    members = members.withColumn("event_id", (F.col("doc_id") + F.col("position") * 7) % 90)
    allowed = table(spark, base, "events").where("event_type <> 'view'").select("event_id")
    hits = graph.thread_hits(_threads(spark, base), members, "doc_id", "event_id", 20, allowed)
    return graph.graph_query(hits, lambda: hits)


# --- memory candidates ---------------------------------------------------------------------------


@query("""
WITH s AS (SELECT doc_id, (contains(lower(text), 'the')::INT + contains(lower(text), 'license')::INT + contains(lower(text), 'qu')::INT)::DOUBLE AS score FROM documents)
SELECT doc_id, score FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 40
""")
def keyword_fallback(spark: SparkSession, base: str) -> DataFrame:
    return memory.keyword_fallback(table(spark, base, "documents"), "The LICENSE qu", "doc_id", "text", 40)


@query(f"""
WITH v AS (SELECT vec_id AS doc_id, round(abs(embedding[2])::DOUBLE, 6) AS score FROM embeddings WHERE label < 4),
w AS (SELECT doc_id, round(bm25 / (1 + bm25), 6) AS score FROM ({_bm25_sql(TERMS)})), g AS (SELECT doc_id, 1.0::DOUBLE AS score FROM labels WHERE toxic = 1),
a AS (SELECT doc_id, 'semantic' AS s, score, 'vector' AS r FROM v UNION ALL SELECT doc_id, 'keyword', score, 'keyword' FROM w UNION ALL SELECT doc_id, 'graph', score, 'entity' FROM g)
SELECT doc_id, coalesce(max(score) FILTER (s = 'semantic'), 0) AS semantic, coalesce(max(score) FILTER (s = 'keyword'), 0) AS keyword,
  coalesce(max(score) FILTER (s = 'graph'), 0) AS graph, array_to_string(list_sort(list(DISTINCT r)), ',') AS reasons FROM a JOIN documents USING (doc_id) GROUP BY 1
""")
def memory_gather(spark: SparkSession, base: str) -> DataFrame:
    """Candidates of all signals that are items, with each signal's best score and the reasons."""
    near = table(spark, base, "embeddings").where("label < 4").select(
        F.col("vec_id").alias("doc_id"), F.round(F.abs(F.get("embedding", F.lit(1))).cast("double"), 6).alias("score")
    )
    words = _bm25(spark, base).select("doc_id", F.round(F.col("bm25") / (1 + F.col("bm25")), 6).alias("score"))
    linked = table(spark, base, "labels").where("toxic = 1").select("doc_id", F.lit(1.0).alias("score"))
    out = memory.gather({"semantic": (near, "vector"), "keyword": (words, "keyword"), "graph": (linked, "entity")}, "doc_id")
    out = out.join(table(spark, base, "documents").select("doc_id"), "doc_id", "left_semi")
    return out.withColumn("reasons", F.array_join("reasons", ","))


@query("""
SELECT s_suppkey, s_nationkey FROM supplier WHERE s_acctbal > 0 AND s_suppkey % 3 = 0
""")
def active_pins(spark: SparkSession, base: str) -> DataFrame:
    """Pins of active items only."""
    items = table(spark, base, "supplier")
    pins = items.where("s_suppkey % 3 = 0").select("s_suppkey", "s_nationkey")
    return pins.join(items.where("s_acctbal > 0").select("s_suppkey"), "s_suppkey", "left_semi")


@query("""
SELECT e.event_id, count(*) FILTER (o.event_type = 'view') AS views FROM events e LEFT JOIN events o
  ON o.user_id = e.user_id AND o.event_type = 'view' AND date_trunc('hour', o.ts) = date_trunc('hour', e.ts) WHERE e.event_type = 'click' GROUP BY 1
""")
def span_of_event(spark: SparkSession, base: str) -> DataFrame:
    """A join over two columns, counted on the smaller side before it."""
    hour = F.date_trunc("hour", "ts").alias("hour")
    rows = table(spark, base, "events")
    views = rows.where("event_type = 'view'").groupBy("user_id", hour).agg(F.count("*").alias("views"))
    clicks = rows.where("event_type = 'click'").select("event_id", "user_id", hour)
    joined = clicks.join(views, ["user_id", "hour"], "left")
    return joined.select("event_id", F.coalesce("views", F.lit(0)).alias("views"))


@query("""
SELECT conv_id, string_agg(role || ':' || n_chars, ',' ORDER BY turn, role) AS members FROM (
  SELECT conv_id, turn, role, coalesce(n_chars, -1) AS n_chars FROM conversations LEFT JOIN documents ON doc_id = conv_id * 10 + turn) GROUP BY 1
""")
def thread_events(spark: SparkSession, base: str) -> DataFrame:
    """Members of threads with their events, in order."""
    members = table(spark, base, "conversations").withColumn("doc_id", F.col("conv_id") * 10 + F.col("turn"))
    events = table(spark, base, "documents").select("doc_id", "n_chars")
    joined = members.join(events, "doc_id", "left")
    listed = F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("n_chars", F.lit(-1)).alias("n"))))
    shown = F.transform(listed, lambda x: F.concat(x["role"], F.lit(":"), x["n"]))
    return joined.groupBy("conv_id").agg(F.array_join(shown, ",").alias("members"))


@query("""
WITH p AS (SELECT event_id, user_id, ts, event_type, props FROM events WHERE event_type <> 'signup'), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM p)
SELECT user_id, max(epoch_us(ts)) AS last_us, count(*) AS n FROM n GROUP BY 1
""")
def latest_update(spark: SparkSession, base: str) -> DataFrame:
    """The latest time of a key's rows: what a heartbeat or a snapshot shows."""
    rows = table(spark, base, "events").where("event_type <> 'signup'")
    return rows.groupBy("user_id").agg(F.unix_micros(F.max("ts")).alias("last_us"), F.count("*").alias("n"))


@query("""
SELECT r.page_id, e.doc_id IS NOT NULL AND e.quality = 1 AND d.lang = 'en' AS fresh FROM pages r LEFT JOIN labels e ON e.doc_id = r.page_id LEFT JOIN documents d ON d.doc_id = e.doc_id
""")
def enrichment_fresh(spark: SparkSession, base: str) -> DataFrame:
    """Whether an event's enrichment is there, of the current schema, and its result by the current model."""
    done = table(spark, base, "labels").select("doc_id", "quality")
    results = table(spark, base, "documents").select("doc_id", "lang")
    joined = table(spark, base, "pages").select("page_id").join(done, F.col("page_id") == F.col("doc_id"), "left")
    joined = joined.join(results, "doc_id", "left")
    fresh = F.col("doc_id").isNotNull() & (F.col("quality") == 1) & (F.col("lang") == "en")
    return joined.select("page_id", F.coalesce(fresh, F.lit(False)).alias("fresh"))


@query("""
SELECT o_custkey, string_agg(o_orderkey || '>' || coalesce(c, ''), ' ' ORDER BY o_orderkey) AS claims FROM orders LEFT JOIN (
  SELECT l_orderkey, string_agg(l_linenumber::VARCHAR, '+' ORDER BY l_linenumber) AS c FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1
""")
def claims_of_answers(spark: SparkSession, base: str) -> DataFrame:
    """Answers with their claims, and each claim's citations, in order."""
    cites = table(spark, base, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("c"))
    claims = table(spark, base, "orders").select("o_custkey", "o_orderkey").join(cites, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    shown = F.concat("o_orderkey", F.lit(">"), F.coalesce(F.array_join(F.col("c").cast("array<string>"), "+"), F.lit("")))
    listed = F.array_sort(F.collect_list(F.struct("o_orderkey", shown.alias("s"))))
    return claims.groupBy("o_custkey").agg(F.array_join(F.transform(listed, lambda x: x["s"]), " ").alias("claims"))


@query("""
SELECT 'lineitem' AS part, count(*) AS n FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-06-30'
UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-06-30'
""")
def delete_counts(spark: SparkSession, base: str) -> DataFrame:
    """What a range delete would take of each table."""
    out = None
    for name, ts in (("lineitem", "l_shipdate"), ("orders", "o_orderdate")):
        rows = table(spark, base, name).where(F.col(ts).between("1996-01-01", "1996-06-30"))
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""
SELECT user_id, event_id, epoch_us(ts) AS ts_us FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 25
""")
def timeline(spark: SparkSession, base: str) -> DataFrame:
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, base, "events").select("user_id", "event_id", "ts").withColumn("n", first).where("n <= 25")
    return rows.select("user_id", "event_id", F.unix_micros("ts").alias("ts_us"))


@query("""
WITH f AS (SELECT *, CASE WHEN event_type = 'signup' THEN CASE WHEN event_id % 3 = 0 THEN '' ELSE 'app' || event_id % 4 END END AS ctx FROM events WHERE event_type IN ('signup', 'click')),
a AS (SELECT *, max(CASE WHEN ctx IS NOT NULL THEN (ts, event_id, ctx) END) OVER (PARTITION BY user_id ORDER BY ts) AS m FROM f)
SELECT event_id, m[3] AS context FROM a WHERE event_type = 'signup' AND m[3] = ctx AND ctx <> ''
""")
def overlay_foreground(spark: SparkSession, base: str) -> DataFrame:
    """Foreground changes that set a context: denied processes set none."""
    rows = table(spark, base, "events").where("event_type in ('signup', 'click')")
    app = F.when(F.col("event_id") % 3 == 0, "Denied").otherwise(F.concat(F.lit("app"), F.col("event_id") % 4))
    rows = rows.select("user_id", "ts", "event_id", F.when(F.col("event_type") == "signup", "foreground").otherwise("input").alias("kind"), app.alias("app"))
    out = sessions.input_activity(rows, "user_id", "ts", "event_id", "kind", "app", ["denied "], 60)
    return out.where("kind = 'foreground'").select("event_id", F.col("app").alias("context"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def distinct_ids(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "events").select("user_id", "event_type").distinct()
