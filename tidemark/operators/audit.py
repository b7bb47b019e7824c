"""Audit and evaluation: integrity, provenance, ledgers, conflicts, coverage, metrics, percentiles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import ordered


def orphans(children: Mapping[str, tuple[DataFrame, str]], parents: DataFrame, parent_key: str) -> DataFrame:
    """``(name, n)``: rows of each child table whose key no parent has."""
    keys = parents.select(F.col(parent_key).alias("_k")).distinct()
    out = None
    for name, (rows, key) in sorted(children.items()):
        lost = rows.where(F.col(key).isNotNull()).join(keys, F.col(key) == F.col("_k"), "left_anti")
        one = lost.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def first_reason(**checks: Column) -> Column:
    """Name of the first check, in order, that fails; null when none does."""
    out = None
    for name, failed in checks.items():
        out = F.when(failed, name) if out is None else out.when(failed, name)
    return out


def all_reasons(**checks: Column) -> Column:
    """Names of all checks that fail, in order."""
    return F.array_compact(F.array(*(F.when(failed, F.lit(name)) for name, failed in checks.items())))


def audit_summary(requests: DataFrame, key: str, children: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """requests with a count from each child table, 0 where it has none; children are counted before the join."""
    out = requests
    for name, (rows, child_key) in children.items():
        counted = rows.groupBy(F.col(child_key).alias("_k")).agg(F.count("*").alias(name))
        out = out.join(counted, F.col(key) == F.col("_k"), "left").drop("_k")
    return out.select(*requests.columns, *(F.coalesce(n, F.lit(0)).alias(n) for n in children))


# --- hash-chained ledgers ------------------------------------------------------------------


def chain(entries: DataFrame, by: str, payload: Column, *order: str) -> DataFrame:
    """entries with ``prev_hash`` and ``entry_hash``; each hash covers the one before in its key.

    A key's entries go through in order with the last hash carried on.
    """

    packed = entries.withColumn("_payload", F.coalesce(payload, F.lit("")))
    ready = packed.repartition(by).sortWithinPartitions(by, *order)
    at, width = entries.columns.index(by), len(entries.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = object(), ""
        for batch in batches:
            before, after = [], []
            for own, content in zip(batch.column(at).to_pylist(), batch.column(width).to_pylist()):
                if own != group:
                    group, held = own, ""
                before.append(held)
                held = hashlib.sha256((held + content).encode()).hexdigest()
                after.append(held)
            hashes = [pa.array(before, pa.string()), pa.array(after, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *hashes], [*batch.schema.names[:-1], "prev_hash", "entry_hash"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema)
    return ready.mapInArrow(run, f"{schema}, prev_hash string, entry_hash string")


def verify_chain(entries: DataFrame, by: str, payload: Column, *order: str) -> DataFrame:
    """entries with ``valid``: the hash matches its content, and ``prev_hash`` the entry before."""
    w = Window.partitionBy(by).orderBy(*order)
    linked = F.col("prev_hash") == F.coalesce(F.lag("entry_hash").over(w), F.lit(""))
    own = F.col("entry_hash") == F.sha2(F.concat("prev_hash", payload), 256)
    return entries.withColumn("valid", linked & own)


# --- claims and answers ----------------------------------------------------------------------

# Fields that evidence states, each with its pattern.
STATED = (
    ("amount", r"(?i)\b(price|cost|total|amount)\b\s*[:=]?\s*\$?([0-9,.]+)"),
    ("version", r"(?i)\b(version|ver)\b\s*[:=]?\s*([0-9.]+)"),
    ("status", r"(?i)\b(status)\b\s*[:=]?\s*([a-zA-Z0-9_-]+)"),
)


def stated_values(rows: DataFrame, column: str, *keep: str) -> DataFrame:
    """``(keep, field, value)`` of everything that texts state about the known fields; values without commas, lower-cased."""
    found = F.array(
        *(
            F.struct(F.lit(name).alias("field"), F.regexp_extract_all(F.col(column), F.lit(p), F.lit(2)).alias("values"))
            for name, p in STATED
        )
    )
    each = rows.select(*keep, F.inline(found)).select(*keep, "field", F.explode("values").alias("value"))
    return each.withColumn("value", F.lower(F.trim(F.regexp_replace("value", ",", ""))))


def conflicts(evidence: DataFrame, by: str, ts: str, column: str) -> DataFrame:
    """``(by, fields, conflict, changed)`` of each set of evidence texts.

    ``fields`` are those with two or more different values. Such values conflict if
    all evidence of the set has one time, whatever it states; else they changed.
    """
    counts = stated_values(evidence, column, by).groupBy(by, "field").agg(F.count_distinct("value").alias("n"))
    several = counts.where("n >= 2").groupBy(by).agg(F.array_sort(F.collect_list("field")).alias("fields"))
    times = evidence.groupBy(by).agg(F.min(ts).alias("first"), F.max(ts).alias("last"))
    some = F.col("fields").isNotNull()
    return times.join(several, by, "left").select(
        by,
        F.coalesce("fields", F.array().cast("array<string>")).alias("fields"),
        (some & F.col("first").eqNullSafe(F.col("last"))).alias("conflict"),
        (some & ~F.col("first").eqNullSafe(F.col("last"))).alias("changed"),
    )


#: A sentence that says that there is nothing to cite (fixed values).
META = ("no evidence", "not enough evidence")


def cited_sentences(answer: Column, known: Column) -> Column:
    """``array<struct<text, citations>>``: an answer's sentences with the known evidence ids that each cites.

    Citations that begin a sentence belong to the one before if that has none; a sentence
    of nothing but citations is merged into the one before.
    """
    known_of = lambda s: F.array_distinct(F.filter(text.citations(s), lambda c: F.array_contains(known, c)))
    each = F.transform(text.sentences(answer), lambda s: F.struct(s.alias("text"), known_of(s).alias("citations")))
    none = F.slice(each, 1, 0)
    before = lambda done: F.slice(done, 1, F.size(done) - 1)
    one = lambda t, c: F.array(F.struct(t.alias("text"), c.alias("citations")))

    def carry(done: Column, x: Column) -> Column:
        lead = known_of(F.regexp_extract(x["text"], r"^\s*(?:" + text.CITATION + r"\s*)+", 0))
        last = F.try_element_at(done, F.lit(-1))
        moved = F.concat(
            before(done), one(last["text"], lead), one(x["text"], F.array_except(x["citations"], lead))
        )
        free = (F.size(done) > 0) & (F.size(lead) > 0) & (F.size(last["citations"]) == 0)
        return F.when(free, moved).otherwise(F.concat(done, F.array(x)))

    def merge(done: Column, x: Column) -> Column:
        only = F.trim(F.regexp_replace(x["text"], text.CITATION, "")) == ""
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(before(done), one(last["text"], F.array_union(last["citations"], x["citations"])))
        return F.when((F.size(done) > 0) & only, joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.aggregate(each, none, carry), none, merge)


def coverage(answer: Column, known: Column, meta_counts: bool = True) -> Column:
    """Share of an answer's sentences that cite known evidence; 0 without sentences.

    With ``meta_counts`` False sentences that say there is no evidence are left out.
    """
    parts = cited_sentences(answer, known)
    if not meta_counts:
        meta = lambda s: F.lower(s["text"]).rlike("|".join(META))
        parts = F.filter(parts, lambda s: ~meta(s))
    cited = F.filter(parts, lambda s: F.size(s["citations"]) > 0)
    return F.when(F.size(parts) > 0, F.size(cited) / F.size(parts)).otherwise(F.lit(0.0))


def claim_errors(claims: Column, known: Column, tokens: Column) -> Column:
    """What a rule-based verifier finds wrong with ``array<struct<evidence_ids, entity_tokens>>``, in order."""

    def of(c: Column, i: Column) -> Column:
        name = F.concat(F.lit("Claim "), (i + 1).cast("string"))
        wrong = F.array_compact(
            F.array(
                F.when(F.size(F.array_except(c["evidence_ids"], known)) > 0, F.concat(name, F.lit(" references unknown evidence"))),
                F.when(
                    F.size(F.array_except(c["entity_tokens"], tokens)) > 0,
                    F.concat(name, F.lit(" references unknown entity tokens")),
                ),
            )
        )
        return F.when(F.size(c["evidence_ids"]) <= 0, F.array(F.concat(name, F.lit(" missing evidence IDs")))).otherwise(wrong)

    return F.flatten(F.transform(claims, of))


def entailed(claim: Column, evidence: Column) -> Column:
    """Whether every number of a claim occurs in its evidence."""
    numbers = lambda c: F.regexp_extract_all(c, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    return F.size(F.array_except(numbers(claim), numbers(evidence))) == 0


def answer_mode(conflict: Column, blocked: Column, share: Column, none: float = 0.2, least: float = 0.6) -> Column:
    """Mode of an answer; conflict comes before blocking, and that before missing evidence.

    Below ``none`` the answer counts as without evidence, below ``least`` as not enough of it: one mode for both.
    """
    return (
        F.when(conflict, "CONFLICT")
        .when(blocked, "BLOCKED")
        .when(share < max(none, least), "NO_EVIDENCE")
        .otherwise("NORMAL")
    )


# --- metrics ---------------------------------------------------------------------------------


def retrieval_metrics(results: DataFrame, expected: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """``(recall, mrr, n_queries)`` of ranked results against the expected items of each query."""
    hits = results.join(expected, [query, item]).groupBy(query).agg(
        F.count_if(F.col("rank") <= k).alias("found"), F.min("rank").alias("first")
    )
    wanted = expected.groupBy(query).agg(F.count("*").alias("wanted"))
    each = wanted.join(hits, query, "left")
    return each.agg(
        F.round(F.avg(F.coalesce("found", F.lit(0)) / F.col("wanted")), 6).alias("recall"),
        F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
        F.count("*").alias("n_queries"),
    )


#: Metrics of an evaluation, and whether the least or the greatest of repeats is the worst (fixed values).
METRICS = {"citation_coverage": "min", "verifier_pass_rate": "min", "refusal_rate": "max", "mean_latency_ms": "max"}


def eval_metrics(cases: DataFrame, *by: str) -> DataFrame:
    """``(by, METRICS)`` of evaluated cases ``(cited, verified, refused, ms)``."""
    share = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    return cases.groupBy(*by).agg(
        share("cited").alias("citation_coverage"), share("verified").alias("verifier_pass_rate"),
        share("refused").alias("refusal_rate"), F.round(F.avg("ms"), 6).alias("mean_latency_ms"),
    )


def over_repeats(metrics: DataFrame, mode: str, *by: str) -> DataFrame:
    """METRICS of repeated evaluations: their means, or the worst of each."""
    if mode not in ("mean", "worst_case"):
        raise ValueError(f"unknown mode {mode!r}")
    worst = {"min": F.min, "max": F.max}
    of = (lambda name, end: F.round(F.avg(name), 6)) if mode == "mean" else (lambda name, end: worst[end](name))
    return metrics.groupBy(*by).agg(*(of(name, end).alias(name) for name, end in METRICS.items()))


def within_latency(elapsed_ms: Column, budget_ms: float, slow_machine: bool = False) -> Column:
    """Whether a request kept to its budget: twice of it, three times on a slow machine (fixed values)."""
    return elapsed_ms <= budget_ms * (3 if slow_machine else 2)


def summary(rows: DataFrame, column: str, *by: str) -> DataFrame:
    """Least, median, 95th percentile (interpolated linearly) and greatest value; no group's values meet in one task."""
    ends = rows.groupBy(*by).agg(F.min(column).alias("min"), F.max(column).alias("max"))
    found = ordered.exact_quantiles(rows, column, by, (0.5, 0.95))
    levels = found.groupBy(*by).agg(
        F.max(F.when(F.col("level") == 0.5, F.col("value"))).alias("median"),
        F.max(F.when(F.col("level") == 0.95, F.col("value"))).alias("p95"),
    )
    out = ends.join(levels, list(by), "left") if by else ends.join(F.broadcast(levels))
    return out.select(*by, *(F.round(c, 6).alias(c) for c in ("min", "median", "p95", "max")))


def histogram(rows: DataFrame, column: str, bounds: Sequence[float]) -> DataFrame:
    """``(bound, n)``: rows up to each bound and above the one before; the last bound is infinite (null)."""
    edges = [*bounds, None]
    nth = F.size(F.filter(F.array(*(F.lit(float(b)) for b in bounds)), lambda b: F.col(column) > b))
    counted = rows.where(F.col(column).isNotNull()).groupBy(nth.alias("i")).agg(F.count("*").alias("n"))
    spark = rows.sparkSession
    table = spark.createDataFrame([(i, None if b is None else float(b)) for i, b in enumerate(edges)], "i int, bound double")
    return table.join(counted, "i", "left").select("i", "bound", F.coalesce("n", F.lit(0)).alias("n"))


def histogram_quantile(buckets: DataFrame, q: float) -> DataFrame:
    """One row: the quantile by linear interpolation in the first bucket that reaches it.

    In the infinite bucket the bound before counts.
    """
    order = Window.orderBy("i")
    upto = buckets.withColumn("upto", F.sum("n").over(order)).withColumn("low", F.coalesce(F.lag("bound").over(order), F.lit(0.0)))
    marked = upto.withColumn("goal", F.sum("n").over(Window.partitionBy()) * q).where("upto >= goal and n > 0")
    first = marked.orderBy("i").limit(1)
    inside = F.col("low") + (F.col("bound") - F.col("low")) * (F.col("goal") - (F.col("upto") - F.col("n"))) / F.col("n")
    return first.select(F.round(F.coalesce(inside, F.col("low")), 6).alias("value"))


def sensitivity(results: DataFrame, base: str, query: str, variant: str, item: str) -> DataFrame:
    """``(variant, jaccard)``: mean similarity of each variant's items to the base variant's, over queries."""
    sets = results.groupBy(query, variant).agg(F.collect_set(item).alias("s"))
    one = sets.where(F.col(variant) == base).select(query, F.col("s").alias("b"))
    both = sets.where(F.col(variant) != base).join(one, query)
    share = F.size(F.array_intersect("s", "b")) / F.size(F.array_union("s", "b"))
    return both.groupBy(variant).agg(F.round(F.avg(share), 6).alias("jaccard"))


#: Limits of an instability report (fixed values): least mean similarity, greatest share of changed modes.
LEAST_JACCARD, MOST_FLIPS = 0.4, 0.5


def changed_lists(lists: DataFrame, sizes: Mapping[str, int], top_n: int, query: str, item: str, c: int = 60) -> DataFrame:
    """``(query, variant, item, rank)``: fused lists of the given sizes (``base``) and with each size one less and one more.

    ``lists`` has ``(query, signal, item, rank)`` with one row more than each signal's size, so that one
    retrieval serves all variants. Lists are fused by reciprocal ranks; ties go to the smaller item.
    """
    base = {**sizes, "top_n": top_n}
    variants = [("base", base)] + [(f"{n}{d:+d}", {**base, n: max(1, base[n] + d)}) for n in base for d in (-1, 1)]
    kinds = F.array(*(F.struct(F.lit(v).alias("variant"), *(F.lit(n).alias(f"_{s}") for s, n in of.items())) for v, of in variants))
    limit = F.coalesce(*(F.when(F.col("signal") == s, F.col(f"_{s}")) for s in sizes))
    each = lists.select("*", F.inline(kinds)).where(F.col("rank") <= limit)
    # Whole numbers add up alike in any order.
    fused = each.groupBy(query, "variant", item, "_top_n").agg(F.sum(F.floor(F.lit(1e9) / (c + F.col("rank")))).alias("score"))
    w = Window.partitionBy(query, "variant").orderBy(F.desc("score"), item)
    ranked = fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.col("_top_n"))
    return ranked.select(query, "variant", item, "rank")


def instability(results: DataFrame, answers: DataFrame, query: str, item: str) -> DataFrame:
    """One row: how much results ``(query, variant, item)`` and answers ``(query, variant, mode, coverage)`` hang on the sizes of lists.

    ``(mean_jaccard, mode_flip_rate, coverage_delta_mean, variants, failed)`` over all queries and variants
    but ``base``; a query without results in a variant has the empty set there, and two empty sets are equal.
    """
    sets = results.groupBy(query, "variant").agg(F.collect_set(item).alias("s"))
    every = answers.join(sets, [query, "variant"], "left").withColumn("s", F.coalesce("s", F.array().cast(results.select(F.array(item)).schema[0].dataType)))
    base = every.where("variant = 'base'").select(query, F.col("s").alias("s0"), F.col("mode").alias("mode0"), F.col("coverage").alias("coverage0"))
    both = every.where("variant != 'base'").join(base, query)
    union = F.size(F.array_union("s", "s0"))
    share = F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("s", "s0")) / union)
    out = both.agg(
        F.round(F.avg(share), 6).alias("mean_jaccard"),
        F.round(F.avg((F.col("mode") != F.col("mode0")).cast("double")), 6).alias("mode_flip_rate"),
        F.round(F.avg(F.abs(F.col("coverage") - F.col("coverage0"))), 6).alias("coverage_delta_mean"),
        F.count_distinct("variant").alias("variants"),
    )
    return out.withColumn("failed", (F.col("mean_jaccard") < LEAST_JACCARD) | (F.col("mode_flip_rate") > MOST_FLIPS))


def change_ratio(old: DataFrame, new: DataFrame, item: str, n: int) -> DataFrame:
    """One row: the share of the new list's first n that isn't among the old list's."""
    fresh = new.where(F.col("rank") <= n).join(old.where(F.col("rank") <= n), item, "left_anti")
    return fresh.agg((F.count("*") / n).alias("ratio"))


def gate(measured: DataFrame, baseline: DataFrame, on: str, percent: float, absolute: float) -> DataFrame:
    """measured with ``delta``, ``failed`` (over the baseline by both tolerances) and ``improved`` (below it)."""
    both = measured.join(baseline.select(on, F.col("value").alias("base")), on)
    delta = F.col("value") - F.col("base")
    return (
        both.withColumn("delta", delta)
        .withColumn("failed", (delta > F.col("base") * percent / 100) & (delta > absolute))
        .withColumn("improved", delta < 0)
    )


def counter_rates(samples: DataFrame, by: str, ts: str, value: str) -> DataFrame:
    """``(by, total, per_minute)``: sum of a counter's samples and the rate between the last two."""
    w = Window.partitionBy(by).orderBy(F.desc(ts))
    last = samples.withColumn("n", F.row_number().over(w)).where("n <= 2")
    ends = last.groupBy(by).agg(
        F.max(F.when(F.col("n") == 1, F.col(value))).alias("v1"), F.max(F.when(F.col("n") == 2, F.col(value))).alias("v0"),
        F.max(F.when(F.col("n") == 1, F.unix_micros(ts))).alias("t1"), F.max(F.when(F.col("n") == 2, F.unix_micros(ts))).alias("t0"),
    )
    minutes = (F.col("t1") - F.col("t0")) / 6e7
    rate = F.when(minutes > 0, (F.col("v1") - F.col("v0")) / minutes).otherwise(F.lit(0.0))
    totals = samples.groupBy(by).agg(F.round(F.sum(value), 4).alias("total"))
    return totals.join(ends.select(by, F.round(F.coalesce(rate, F.lit(0.0)), 6).alias("per_minute")), by)
