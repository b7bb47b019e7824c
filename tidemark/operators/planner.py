"""Tiered retrieval: which stages a query gets, within a budget, and the combined result."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import browse, lexical, search

# Milliseconds that stages need, and sizes of their results.
STAGE_MS = {"dense": 180, "rerank": 200}
TOTAL_MS, REDUCE = 1500, 0.5
K_LEXICAL, K_DENSE, FUSION_K, TOP_N = 24, 24, 32, 24


@dataclass
class Budget:
    """Milliseconds that are left; spending is the caller's to report, so plans are reproducible."""

    left: int = TOTAL_MS
    spent: dict[str, int] = field(default_factory=dict)

    def spend(self, stage: str, ms: int) -> None:
        self.spent[stage] = self.spent.get(stage, 0) + ms
        self.left -= ms

    def allows(self, stage: str) -> bool:
        return self.left >= STAGE_MS.get(stage, 0)

    def size(self, k: int) -> int:
        """k, or a part of it once less than half of the budget is left."""
        return k if self.left >= TOTAL_MS / 2 else max(1, int(k * REDUCE))


def stages_within(left_ms: Column) -> tuple[Column, Column]:
    """(stages, reasons) of requests with so many milliseconds left: FAST always, the others as they fit."""
    fits = {tier: left_ms >= STAGE_MS[stage] for tier, stage in (("FUSION", "dense"), ("RERANK", "rerank"))}
    stages = F.array_compact(F.array(F.lit("FAST"), *(F.when(ok, tier) for tier, ok in fits.items())))
    return stages, F.array_compact(F.array(*(F.when(~ok, f"{tier}:budget") for tier, ok in fits.items())))


def size_within(left_ms: Column, k: int) -> Column:
    """Budget.size of a column."""
    return F.when(left_ms >= TOTAL_MS / 2, k).otherwise(max(1, int(k * REDUCE)))


@dataclass(frozen=True)
class Plan:
    """The stages of one query and why."""

    kind: str
    stages: tuple[str, ...]
    reasons: tuple[str, ...]


def plan(query: str, budget: Budget, has_filters: bool = False, help_rate: Mapping[str, float] | None = None) -> Plan:
    """FAST always, FUSION unless dense search doesn't fit, RERANK unless it doesn't fit or hasn't helped."""
    kind, stages, reasons = lexical.query_class(query, has_filters), ["FAST"], []
    for tier, stage in (("FUSION", "dense"), ("RERANK", "rerank")):
        if not budget.allows(stage):
            reasons.append(f"{tier}:budget")
        elif (help_rate or {}).get(tier, 1.0) < 0.05:
            reasons.append(f"{tier}:unhelpful")
        else:
            stages.append(tier)
    return Plan(kind, tuple(stages), tuple(reasons))


def retrieve(
    docs: DataFrame, query: str, key: str, column: str, budget: Budget,
    dense: Callable[[int], DataFrame] | None = None, rerank: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``(key, score, rank, gap, tier)`` by the planned stages; ``dense(k)`` gives ``(key, score)`` rows.

    A query without a term (punctuation alone) is looked up literally.
    """
    chosen = plan(query, budget)
    k = budget.size(K_LEXICAL)
    lists = []
    for variant in lexical.rewrites(query):
        words = [w for w in re.findall(text.TERM, variant.lower()) if w != "and"]
        if not words:
            continue
        hits = lexical.bm25(docs, words, key, column)
        hits = hits.select(key, F.round(F.col("bm25") / (1 + F.col("bm25")), 6).alias("score"))
        lists.append(search.ranked(hits.orderBy(F.desc("score"), key).limit(k), key))
        if "FUSION" not in chosen.stages:
            break
    if "FUSION" in chosen.stages and dense is not None:
        lists.append(search.ranked(dense(budget.size(K_DENSE)), key))
    if not lists:
        found = browse.substring_search(docs, [column], query, key, TOP_N).select(key, "score")
    elif len(lists) == 1:
        found = lists[0].select(key, "score")
    else:
        found = search.fuse(lists, key).limit(FUSION_K).select(key, "score")
    if "RERANK" in chosen.stages and rerank is not None:
        found = rerank(found)
    best = found.orderBy(F.desc("score"), key).limit(TOP_N)
    return search.ranked(best, key).withColumn("tier", F.lit(chosen.stages[-1]))


def tier_usefulness(log: DataFrame) -> DataFrame:
    """``(tier, n, help_rate, mean_ms)`` of a log of ``(tier, cited, ms)``."""
    return log.groupBy("tier").agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.col("cited").cast("double")), 6).alias("help_rate"),
        F.round(F.avg("ms"), 6).alias("mean_ms"),
    )


def evidence(hits: DataFrame, key: str, content: str) -> DataFrame:
    """hits once per (key, content hash), numbered E1, E2, ... in that order."""
    from pyspark.sql import Window

    own = hits.withColumn("content_hash", F.sha2(F.coalesce(F.col(content), F.lit("")), 256))
    once = search.best_of_each(own.withColumn("_pair", F.concat_ws("|", key, "content_hash")), "_pair", F.desc("score"))
    nth = F.row_number().over(Window.orderBy(key, "content_hash"))
    return once.drop("_pair").withColumn("evidence_id", F.concat(F.lit("E"), nth.cast("string")))
