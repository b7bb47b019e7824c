"""Queries: policies, staleness, backlog, strategy comparison, scouting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import policy
from tidemark.plans.registry import query
from tidemark.sources.tables import table

AS_OF = "2024-01-31 00:00:00"


def _now():
    return F.lit(AS_OF).cast("timestamp")


def _any_sql(column: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches(coalesce({column}, ''), '{p}')" for p in patterns) + ")"


def _ascii_words(column: str) -> str:
    """SQL of a text in which ASCII stands for other letters and marks, for its word boundaries know no others."""
    marked = rf"regexp_replace({column}, '[^\p{{L}}\p{{Nd}}\p{{Mn}}\x00-\x7F]', '~', 'g')"
    return rf"regexp_replace({marked}, '[^\x00-\x7F]', '_', 'g')"


def _index_form(column: str) -> str:
    """SQL of a text in index form; canonical composition stands for compatibility composition."""
    marks, plain = "".join(text.PUNCTUATION), "".join(text.PUNCTUATION.values()).replace("'", "''")
    shown = rf"regexp_replace(translate(nfc_normalize({column}), '{marks}', '{plain}'), '\p{{Cf}}', '', 'g')"
    return rf"trim(regexp_replace({shown}, '\s+', ' ', 'g'), ' ')"


_PERSON = [f"(?i){p}" for p in policy.PERSON_PATTERNS]
_PREFERENCE = " OR ".join(f"contains(lower({_index_form('text')}), '{w}')" for w in policy.PREFERENCE_WORDS)


@query(f"""
SELECT doc_id, CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN 'content_empty' WHEN doc_id % 11 = 0 THEN 'policy_missing' ELSE concat_ws(',',
  CASE WHEN doc_id % 5 = 0 THEN 'policy_audience_missing' END, CASE WHEN doc_id % 7 = 0 THEN 'policy_sensitivity_invalid' END,
  CASE WHEN doc_id % 5 = 0 OR lang = 'es' THEN 'policy_audience_blocked' END,
  CASE WHEN {_any_sql('text', ["(?i)" + p.removeprefix("(?i)") for p in text.PII_PATTERNS])} THEN 'policy_pii_detected' END,
  CASE WHEN {_any_sql('text', [p for p, _ in text.SECRET_PATTERNS])} THEN 'policy_secret_detected' END,
  CASE WHEN doc_id % 13 = 0 THEN 'policy_person_entity_detected' END,
  CASE WHEN {_any_sql(_ascii_words(_index_form('text')), _PERSON)} THEN 'policy_person_text_detected' END,
  CASE WHEN {_PREFERENCE} OR source = 'src1' THEN 'policy_preference_detected' END) END AS reasons FROM documents
""")
def proposal_policy(spark: SparkSession, base: str) -> DataFrame:
    nth = lambda n: F.col("doc_id") % n == 0
    reasons = policy.proposal_reasons(
        F.col("text"),
        F.array(F.when(F.col("source") == "src1", "User_Profile").otherwise("fact")),
        F.array(F.when(nth(13), " Person ").otherwise("place")),
        F.when(nth(7), "secret").otherwise("low"),
        F.when(nth(5), F.array().cast("array<string>")).otherwise(F.array(F.upper("lang"))),
        ["en", "FR", "de"],
        ~nth(11),
    )
    return table(spark, base, "documents").select("doc_id", F.array_join(reasons, ",").alias("reasons"))


@query("""
SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 4 = 0 THEN 'policy_audience_missing' END,
  CASE WHEN c_mktsegment NOT IN ('low', 'medium', 'high') THEN 'policy_sensitivity_invalid' END,
  CASE WHEN c_custkey % 4 = 0 OR c_nationkey > 9 THEN 'policy_audience_blocked' END) AS reasons FROM customer
""")
def query_policy(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "customer")
    who = F.when(F.col("c_custkey") % 4 != 0, F.array(F.col("c_nationkey").cast("string"))).otherwise(F.array().cast("array<string>"))
    reasons = policy.query_policy_reasons(F.col("c_mktsegment"), who, [str(i) for i in range(10)])
    return rows.select("c_custkey", F.array_join(reasons, ",").alias("reasons"))


@query("""
SELECT doc_id, CASE WHEN lang = 'de' THEN 'exclude' WHEN regexp_matches(text, '(?i)licensed under') THEN 'exclude'
  WHEN regexp_matches(text, '(?i)moron|idiot') THEN 'redact' ELSE 'allow' END AS action,
  CASE WHEN lang = 'de' THEN 'blocked_labels' WHEN regexp_matches(text, '(?i)licensed under') THEN 'exclude_pattern'
  WHEN regexp_matches(text, '(?i)moron|idiot') THEN 'redact_pattern' END AS reason FROM documents
""")
def artifact_policy(spark: SparkSession, base: str) -> DataFrame:
    decision = policy.artifact_decision(
        F.col("text"), ["licensed under"], ["moron|idiot"], F.array(F.upper("lang")), [" De "]
    )
    return table(spark, base, "documents").select("doc_id", decision.alias("d")).select("doc_id", "d.*")


@query("""
SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)licensed under') THEN 'exclude'
  WHEN regexp_matches(text, '(?i)moron|idiot') THEN 'redact' ELSE 'allow' END AS action FROM documents
""")
def span_policy(spark: SparkSession, base: str) -> DataFrame:
    decision = policy.artifact_decision(F.col("text"), ["licensed under"], ["moron|idiot"])
    return table(spark, base, "documents").select("doc_id", decision["action"].alias("action"))


@query("""
SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'paused' WHEN user_id % 8 = 3 THEN 'monitor' WHEN event_type = 'error' THEN 'process'
  WHEN regexp_matches(props, ': 6') THEN 'title' END AS reason FROM events
""")
def capture_skip(spark: SparkSession, base: str) -> DataFrame:
    monitor = F.concat(F.lit("m"), F.col("user_id") % 8)
    process = F.concat(F.lit(" "), F.upper("event_type"))
    why = policy.capture_skipped(F.col("event_id") % 9 == 0, monitor, process, F.col("props"), ["m3"], ["Error "], [": 6"])
    return table(spark, base, "events").select("event_id", why.alias("reason"))


@query("SELECT event_id FROM events WHERE event_type NOT IN ('error', 'view')")
def process_deny(spark: SparkSession, base: str) -> DataFrame:
    denied = policy.denied_process(F.upper("event_type"), [" Error", "view", ""])
    return table(spark, base, "events").where(~denied).select("event_id")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def namespace_rows(spark: SparkSession, base: str) -> DataFrame:
    return policy.namespace_view(table(spark, base, "customer"), "BUILDING", "c_mktsegment").select("c_custkey")


@query(f"""
SELECT event_id, epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts) > 172800000000 AS stale FROM events
WHERE event_id % 5 <> 0 OR ts + INTERVAL 10 DAY <= TIMESTAMP '{AS_OF}'
""")
def stale_split(spark: SparkSession, base: str) -> DataFrame:
    items = table(spark, base, "events").withColumn(
        "snoozed", F.when(F.col("event_id") % 5 == 0, F.expr("ts + interval 10 days"))
    )
    return policy.stale_split(items, _now(), 48, "ts", "snoozed").select("event_id", "stale")


@query(f"""
SELECT count(*) FILTER (event_type = 'error') AS missing,
  count(*) FILTER (event_type = 'error' AND (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 3.6e9 > 240) AS at_risk,
  round(max(CASE WHEN event_type = 'error' THEN (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 3.6e9 END), 6)::DOUBLE AS oldest_hours FROM events
""")
def enrichment_backlog(spark: SparkSession, base: str) -> DataFrame:
    return policy.backlog(table(spark, base, "events"), _now(), "ts", F.col("event_type") != "error", 240)


@query("""
WITH e AS (SELECT lang, n_chars, min(text) AS expected FROM documents GROUP BY 1, 2)
SELECT lang AS strategy, round(avg((lower(trim(text)) = lower(trim(expected)))::INT::DOUBLE), 6) AS pass_rate,
  round(avg(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, ceil(length(text) / 4.0)) END), 6)::DOUBLE AS mean_tokens,
  round(avg(n_chars), 6) AS mean_ms FROM documents JOIN e USING (lang, n_chars) GROUP BY 1
""")
def strategy_comparison(spark: SparkSession, base: str) -> DataFrame:
    """Whole texts as answers; expected is the least text of the same language and length."""
    docs = table(spark, base, "documents").select("lang", "n_chars", "text")
    expected = docs.groupBy("lang", "n_chars").agg(F.min("text").alias("expected"))
    rows = docs.join(expected, ["lang", "n_chars"]).withColumnRenamed("lang", "strategy")
    return policy.compare_strategies(rows, "strategy", "text", "expected", "n_chars")


@query("""
WITH h AS (SELECT * FROM part WHERE contains(lower(p_name), 'red') OR (len(list_filter(string_split_regex(lower(p_name), '\\W+'), lambda w: starts_with(w, 'bo'))) > 0
  AND len(list_filter(string_split_regex(lower(p_name), '\\W+'), lambda w: starts_with(w, 'bl'))) > 0) OR contains(lower(p_name), 'bo bl')),
s AS (SELECT p_partkey, round(CASE WHEN max(p_retailprice) OVER () = min(p_retailprice) OVER () THEN 1 ELSE
  (p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()) END, 6) AS score FROM h)
SELECT p_partkey, score, row_number() OVER (ORDER BY score DESC, p_partkey)::INT AS rank FROM s
""")
def scout_rank(spark: SparkSession, base: str) -> DataFrame:
    rows = policy.scout(table(spark, base, "part"), "p_retailprice", "p_name", ["red", "bo bl"], "p_partkey")
    return rows.select("p_partkey", "score", "rank")


@query("""
WITH RECURSIVE d AS (SELECT vec_id, label, list_transform(embedding, lambda x: x > 0.0) AS bits, list_transform(embedding, lambda x: floor(x::DOUBLE * 4)) AS px,
  row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
f AS (SELECT label, 0::BIGINT AS n, []::STRUCT(tm BIGINT, bits BOOLEAN[], px DOUBLE[])[] AS held, NULL::BIGINT AS vec_id, false AS duplicate FROM (SELECT DISTINCT label FROM d)
  UNION ALL SELECT label, n, CASE WHEN same THEN near ELSE list_append(near, {'tm': vec_id, 'bits': bits, 'px': px}) END, vec_id, same FROM (
    SELECT d.*, list_filter(held, lambda o: d.vec_id - o.tm <= 400)[-16:] AS near,
      len(list_filter(list_filter(held, lambda o: d.vec_id - o.tm <= 400)[-16:], lambda o: list_sum(list_transform(list_zip(o.bits, d.bits), lambda z: (z[1] <> z[2])::INT)) <= 26
        AND list_sum(list_transform(list_zip(o.px, d.px), lambda z: abs(z[1] - z[2]))) <= 0.5 * 64)) > 0 AS same
    FROM f JOIN d ON d.label = f.label AND d.n = f.n + 1))
SELECT vec_id, duplicate FROM f WHERE vec_id IS NOT NULL
""")
def frame_duplicates(spark: SparkSession, base: str) -> DataFrame:
    """Duplicate frames by all bits of the hash and the mean error over all pixels, within a time; each decision hangs on earlier ones."""
    sign = F.transform("embedding", lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    bits = F.aggregate(sign, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))
    pixels = F.transform("embedding", lambda x: F.floor(x.cast("double") * 4).cast("double"))
    frames = table(spark, base, "embeddings").select("label", "vec_id", F.timestamp_seconds("vec_id").alias("ts"), bits.alias("bits"), pixels.alias("px"))
    out = policy.frame_duplicates(frames, "label", "ts", "bits", "px", 400, 26 / 64, 0.5, key="vec_id")
    return out.select("vec_id", "duplicate")
