"""Graph and thread retrieval: thread candidates, their events as hits, the fallback, adapters."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def thread_candidates(
    lexical: DataFrame, dense: DataFrame, threads: DataFrame, key: str, limit: int, where: Column | None = None
) -> DataFrame:
    """threads that either list names with ``score``: 0.6 lexical and 0.4 dense, as they are (fixed values).

    A time range or another condition on threads is ``where``; the best ``limit`` stay.
    """
    tagged = [x.select(key, F.col("score").alias(n)) for n, x in (("lexical_score", lexical), ("dense_score", dense))]
    both = tagged[0].join(tagged[1], key, "full")
    both = both.select(key, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("lexical_score", "dense_score")))
    rows = threads if where is None else threads.where(where)
    scored = rows.join(both, key)
    score = F.round(0.6 * F.col("lexical_score") + 0.4 * F.col("dense_score"), 9)
    return scored.withColumn("score", score).orderBy(F.desc("score"), key).limit(max(1, limit))


def recent_threads(threads: DataFrame, ts: str, key: str, limit: int) -> DataFrame:
    """The latest threads with score 0.4: what a query without words gets (fixed value)."""
    return threads.withColumn("score", F.lit(0.4)).orderBy(F.desc(ts), key).limit(limit)


def with_summaries(threads: DataFrame, summaries: DataFrame, key: str, title: str) -> DataFrame:
    """threads with the title and summary of their summary, where they have one; else their own title."""
    own = summaries.select(key, F.col("title").alias("_t"), F.col("summary").alias("_s"))
    joined = threads.join(own, key, "left")
    shown = F.coalesce(F.nullif("_t", F.lit("")), F.col(title), F.lit(""))
    return joined.withColumn("title", shown).withColumn("summary", F.coalesce("_s", F.lit(""))).drop("_t", "_s")


#: What each further place in a thread costs (fixed value).
STEP = 0.01


def thread_hits(candidates: DataFrame, members: DataFrame, thread: str, event: str, limit: int, allowed: DataFrame | None = None) -> DataFrame:
    """``(event, score, snippet)`` of events of candidate threads: the thread's score less a little for each place.

    ``members`` has ``(thread, event, position)``. An event of several threads counts in
    the best; without an allowed event, all events count, as without conditions.
    """
    named = candidates.select(thread, "score", F.coalesce(F.nullif("summary", F.lit("")), "title").alias("snippet"))
    met = members.join(F.broadcast(named), thread)  # candidates are a limited list
    if allowed is not None:
        own = allowed.select(event).distinct()
        some = met.join(own, event, "left_semi")
        none = some.agg((F.count("*") == 0).alias("none"))
        met = met.join(own.withColumn("ok", F.lit(True)), event, "left").join(F.broadcast(none)).where("ok or none")
    score = F.round(F.greatest(F.col("score") - F.col("position") * STEP, F.lit(0.0)), 9)
    best = met.groupBy(event).agg(F.max(F.struct(score.alias("score"), (-F.col(thread)).alias("minus"), "snippet")).alias("b"))
    return best.select(event, "b.score", "b.snippet").orderBy(F.desc("score"), event).limit(limit)


def graph_query(hits: DataFrame, fallback: Callable[[], DataFrame]) -> DataFrame:
    """Thread hits, or the fallback's where there are none. The hits are a limited list: they are run once and held."""
    rows = hits.collect()
    return hits.sparkSession.createDataFrame(rows, hits.schema) if rows else fallback()


def adapters(
    sources: Sequence[tuple[str, Callable[[str, int], DataFrame], int]], query: str, limit: int, tries: int = 3
) -> DataFrame | None:
    """``(event_id, score, snippet, source)`` of all adapters ``(name, ask, most)``, one after the other.

    Each gives its ``most`` results at most and is asked again when it fails, be it when it is asked, when its
    answer is analysed or when its rows are read: they are few and are read here. One that
    fails for good adds nothing. None without an adapter that answers.
    """
    out = None
    for name, ask, most in sources:
        for _ in range(tries):
            try:
                hits = ask(query, min(limit, most)).where("event_id <> ''").limit(min(limit, most))
                hits = hits.select("event_id", F.coalesce("score", F.lit(0.0)).alias("score"), "snippet", F.lit(name).alias("source"))
                hits = hits.sparkSession.createDataFrame(hits.collect(), hits.schema)
                break
            except Exception:  # noqa: BLE001  whatever an adapter raises
                hits = None
        if hits is None:
            continue
        out = hits if out is None else out.unionByName(hits)
    return out
