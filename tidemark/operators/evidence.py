"""From hits to evidence: span choice, decoration, fusion of results, evidence ids, answers, what is kept of a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tidemark.functions import entities, text
from tidemark.operators import ordered

# --- spans -----------------------------------------------------------------------------------


def best_of_spans(hits: DataFrame, event: str, span: str, score: str) -> DataFrame:
    """``(event, score, span_keys)``: an event's best score of its span hits, and the keys that were hit, in order."""
    return hits.groupBy(event).agg(F.max(score).alias("score"), F.array_sort(F.collect_set(span)).alias("span_keys"))


def with_spans(events: DataFrame, spans: DataFrame, event: str, start: str, key: str, *more: str) -> DataFrame:
    """events with ``spans``: their spans as structs by start (then key), empty where there are none."""
    packed = F.struct(F.col(start).alias("start"), F.col(key).alias("span_key"), *more)
    listed = spans.groupBy(event).agg(F.array_sort(F.collect_list(packed)).alias("spans"))
    joined = events.join(listed, event, "left")
    none = F.array().cast(listed.schema["spans"].dataType)
    return joined.withColumn("spans", F.coalesce("spans", none))


def pick_span(spans: Column, matched: Column, query: str) -> Column:
    """The span that a hit shows: the first whose key was matched, else the first that holds the query, else the first."""
    by_key = F.filter(spans, lambda s: F.array_contains(matched, s["span_key"]))
    low = query.lower().strip()
    by_text = F.filter(spans, lambda s: F.contains(F.lower(F.coalesce(s["text"], F.lit(""))), F.lit(low)))
    first = F.get(spans, F.lit(0))
    if not low:
        return F.coalesce(F.get(by_key, F.lit(0)), first)
    return F.coalesce(F.get(by_key, F.lit(0)), F.get(by_text, F.lit(0)), first)


def decorate(results: DataFrame, body: str, query: str) -> DataFrame:
    """results (with ``spans`` and ``span_keys``) with snippet, its offset, the span's box, and whether it can't be cited.

    A result can't be cited when no span, or no box of it, says where it is.
    """
    found, offset = text.snippet(F.coalesce(body, F.lit("")), query)
    span = pick_span(F.col("spans"), F.col("span_keys"), query)
    rows = results.withColumn("span", span).withColumn("snippet", found)
    return rows.select(
        *results.columns, "snippet",
        F.when(F.col("snippet") != "", offset).alias("snippet_offset"),
        F.col("span.span_key").alias("span_key"), F.col("span.bbox").alias("bbox"),
        F.col("span.bbox").isNull().alias("non_citable"),
    )


# --- fusion of results ---------------------------------------------------------------------------

SIGNALS = ("lexical", "dense", "sparse", "late")


def fuse_results(lists: Sequence[DataFrame], key: str, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of result lists with all that is known of each result.

    Lists have ``(key, rank, engine, span_keys)`` and any of the signals. A result has
    the sum of ``1 / (k + rank)``, its best rank, the greatest value of each signal and
    the union of its span keys. Its engine is ``fusion``, unless one graph list alone has it.
    """
    rows = None
    for one in lists:
        signals = (F.col(s).cast("double") if s in one.columns else F.lit(0.0) for s in SIGNALS)
        part = one.select(key, "rank", "engine", "span_keys", *(c.alias(s) for c, s in zip(signals, SIGNALS)))
        rows = part if rows is None else rows.unionByName(part)
    graph = F.startswith(F.coalesce("engine", F.lit("")), F.lit("graph"))
    fused = rows.groupBy(key).agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"),
        F.min("rank").alias("best_rank"),
        F.bool_and(graph).alias("all_graph"),
        F.count("*").alias("n_lists"),
        F.min("engine").alias("own"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("span_keys")))).alias("span_keys"),
        *(F.max(s).alias(s) for s in SIGNALS),
    )
    engine = F.when(F.col("all_graph") & (F.col("n_lists") == 1), F.col("own")).otherwise(F.lit("fusion"))
    return fused.withColumn("engine", engine).drop("own")


def with_graph(primary: DataFrame, graph: DataFrame, key: str) -> DataFrame:
    """Results and those graph results that aren't among them."""
    fresh = graph.join(primary.select(key), key, "left_anti")
    return primary.unionByName(fresh.select(*primary.columns))


# --- evidence --------------------------------------------------------------------------------


def build_evidence(results: DataFrame, event: str, body: str, rank: str = "rank", secret: str | None = None) -> DataFrame:
    """results as evidence: cleaned of injected instructions, each text of an event once, numbered E1, E2, ...

    Numbers follow event and content hash. With a secret, addresses, paths and domains
    are pseudonyms. Of rows with one text the first by rank counts.
    """
    raw = F.coalesce(body, F.lit(""))
    shown = raw if secret is None else entities.pseudonymised(raw, secret)
    rows = results.withColumn("shown", shown)
    rows = rows.withColumn("text", text.without_injection(F.col("shown")))
    rows = rows.withColumn("injection_risk", text.injection_risk(F.col("shown")))
    rows = rows.withColumn("redacted", F.col("injection_risk") > 0).withColumn("content_hash", F.sha2("text", 256))
    once = Window.partitionBy(event, "content_hash").orderBy(rank)
    rows = rows.withColumn("nth", F.row_number().over(once)).where("nth = 1")
    if isinstance(rows.schema[event].dataType, NumericType):
        rows = ordered.rank_over_all(rows, event, "nth_of_all", ties=["content_hash"], rising=True)
    else:  # a list of results with other ids is short
        rows = rows.withColumn("nth_of_all", F.row_number().over(Window.orderBy(event, "content_hash")))
    kind = F.when(F.col("non_citable"), "derived_summary").otherwise("source")
    rows = rows.withColumn("evidence_id", F.concat(F.lit("E"), F.col("nth_of_all").cast("string")))
    return rows.withColumn("kind", kind).drop("shown", "nth", "nth_of_all")


def evidence_summary(evidence: DataFrame) -> DataFrame:
    """One row: how much evidence there is, can be cited, was redacted, and the greatest risk."""
    return evidence.agg(
        F.count("*").alias("total"),
        F.count_if(~F.coalesce("non_citable", F.lit(False))).alias("citable"),
        F.count_if(F.coalesce("redacted", F.lit(False))).alias("redacted"),
        F.round(F.coalesce(F.max("injection_risk"), F.lit(0.0)), 6).alias("max_risk"),
    )


#: What is said when there is nothing to say (fixed values).
NO_EVIDENCE = "Not enough evidence to answer. Try refining the query."
NO_EVENTS = "No events found in the requested time range."


def extractive_answer(evidence: DataFrame, body: str, order: str) -> DataFrame:
    """``(answer, citations)``: every text with its evidence id, a line each, in order."""
    line = F.concat(F.col(body), F.lit(" ["), "evidence_id", F.lit("]"))
    return _answer(evidence, line, F.struct(order, "evidence_id"), NO_EVIDENCE)


def timeline_answer(evidence: DataFrame, ts: str, app: str, title: str, body: str, most: int = 120) -> DataFrame:
    """``(answer, citations)``: a line for each piece of evidence in time order, texts cut to ``most`` characters."""
    flat = F.trim(F.regexp_replace(F.coalesce(body, F.lit("")), r"(?U)\s+", " "))
    short = F.when(F.length(flat) > most, F.concat(F.left(flat, F.lit(most)), F.lit("..."))).otherwise(flat)
    label = F.regexp_replace(F.concat(app, F.lit(": "), F.coalesce(title, F.lit(""))), "^[: ]+|[: ]+$", "")
    line = F.concat(
        F.col(ts), F.lit(" — "), label, F.when(short != "", F.concat(F.lit(" — "), short)).otherwise(F.lit("")),
        F.lit(" ["), "evidence_id", F.lit("]"),
    )
    return _answer(evidence, line, F.struct(ts, "evidence_id"), NO_EVENTS)


def _answer(evidence: DataFrame, line: Column, order: Column, none: str) -> DataFrame:
    packed = F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("line"), F.col("evidence_id").alias("id"))))
    one = evidence.agg(packed.alias("all"))  # of a result list
    answer = F.array_join(F.transform("all", lambda x: x["line"]), "\n")
    return one.select(
        F.when(F.size("all") > 0, answer).otherwise(F.lit(none)).alias("answer"),
        F.transform("all", lambda x: x["id"]).alias("citations"),
    )


# --- what is kept of a run ------------------------------------------------------------------------


def hit_rows(results: DataFrame, query_id: Column, tier: Column, event: str) -> DataFrame:
    """Rows to keep of a run's results, with ids that the same run gives again."""
    ident = text.stable_id("hit", query_id.alias("query_id"), tier.alias("tier"), F.col(event).alias("event"), F.col("rank").alias("rank"))
    return results.select(ident.alias("hit_id"), query_id.alias("query_id"), tier.alias("tier"), event, "rank", "score", "span_key")


def plan_rows(plans: DataFrame) -> DataFrame:
    """Plan decisions ``(query_id, plan, skipped, ...)`` with ids that the same decision gives again; each once."""
    ident = text.stable_id("tier_plan", F.col("query_id"), F.col("plan"), F.col("skipped"))
    return plans.withColumn("decision_id", ident).dropDuplicates(["decision_id"])


TIERS = ("FAST", "FUSION", "RERANK")


def tier_help(hits: DataFrame, cited: DataFrame) -> DataFrame:
    """``(query_id, tier, cited, helped)``: whether a tier found cited spans that no tier before it had.

    ``hits`` has ``(query_id, tier, span_key)`` and ``cited`` ``(query_id, span_key)``.
    """
    place = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))
    met = hits.join(cited, ["query_id", "span_key"], "left_semi").select("query_id", "tier", "span_key", place.alias("place")).distinct()
    first = met.groupBy("query_id", "span_key").agg(F.min("place").alias("first"))
    counted = met.join(first, ["query_id", "span_key"]).groupBy("query_id", "tier").agg(
        F.count("*").alias("cited"), F.bool_or(F.col("place") == F.col("first")).alias("helped")
    )
    every = hits.select("query_id").distinct().withColumn("tier", F.explode(F.array(*map(F.lit, TIERS))))
    joined = every.join(counted, ["query_id", "tier"], "left")
    return joined.select(
        "query_id", "tier", F.coalesce("cited", F.lit(0)).alias("cited"), F.coalesce("helped", F.lit(False)).alias("helped")
    )


def rerank_document(app: Column, title: Column, url: Column, domain: Column, body: Column, most: int = 1000) -> Column:
    """What a reranker reads of an event: its application, title, address and text, without the parts that it lacks."""

    def part(name: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{name}: "), value))

    address = F.when(F.coalesce(url, F.lit("")) != "", url).otherwise(domain)
    plain = F.regexp_replace(F.coalesce(body, F.lit("")), r"(?U)^\s+|\s+$", "")
    joined = F.array_join(F.array_compact(F.array(part("app", app), part("title", title), part("url", address), part("text", plain))), " | ")
    return F.left(joined, F.lit(most))
