"""Compiled contexts: budgets for spans, citations, snapshots and their retention, replaced documents, pins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import documents


def within_budgets(spans: DataFrame, order: str, body: str, most: int, chars: int, total: int) -> DataFrame:
    """The first spans that fit, with texts cut to ``chars``, ``truncated``, ``cite_id`` and the characters up to them.

    The first span that would pass ``total`` ends the list, as does the ``most``-th one; so
    no more than ``most`` rows are ordered.
    """
    head = spans.orderBy(order).limit(most)
    head = head.withColumn("truncated", F.length(body) > chars).withColumn(body, F.left(body, F.lit(chars)))
    w = Window.orderBy(order)
    upto = F.sum(F.length(body)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    nth = F.row_number().over(w)
    rows = head.withColumn("upto", upto).withColumn("nth", nth)
    # Once a span doesn't fit, no later one does: running sums only grow.
    return rows.where(F.col("upto") <= total).withColumn(
        "cite_id", F.concat(F.lit("S"), F.lpad(F.col("nth").cast("string"), 3, "0"))
    )


def compile_context(spans: DataFrame, items: DataFrame, query: str, config_sha256: str, span: str, item: str) -> DataFrame:
    """One row: the snapshot of budgeted spans and chosen items (with ``position``), identified by its content.

    ``snapshot_id`` is the SHA-256 of the canonical JSON of the query, the configuration's
    hash and the ids in order. Spans and items are limited lists.
    """
    in_order = lambda order, value: F.transform(
        F.array_sort(F.collect_list(F.struct(order, F.col(value).cast("string").alias("v")))), lambda x: x["v"]
    )
    kept = spans.agg(
        in_order("nth", span).alias("span_ids"),
        F.coalesce(F.sum(F.col("truncated").cast("long")), F.lit(0)).alias("truncated_spans"),
        F.coalesce(F.max("upto"), F.lit(0)).alias("total_chars"),
        F.max("seen").alias("created"),
    )
    chosen = items.agg(in_order("position", item).alias("item_ids"))
    both = kept.join(F.broadcast(chosen))  # one row each
    ident = F.to_json(
        F.struct(F.lit(config_sha256).alias("config_sha256"), "item_ids", F.lit(query.strip()).alias("query"), "span_ids")
    )
    return both.select(F.sha2(ident, 256).alias("snapshot_id"), F.lit(query.strip()).alias("query"), "*")


def record_snapshot(snapshots: DataFrame, new: DataFrame) -> DataFrame:
    """Snapshots with new ones in the place of those of the same id."""
    return snapshots.join(new, "snapshot_id", "left_anti").unionByName(new.select(*snapshots.columns))


def expired_snapshots(snapshots: DataFrame, created: str, as_of: Column, days: int) -> DataFrame:
    """snapshots with ``expired``: made ``days`` days ago or longer; one without a time never expires."""
    old = F.unix_micros(as_of) - F.unix_micros(created) >= days * 86_400_000_000
    return snapshots.withColumn("expired", F.coalesce(old, F.lit(False)))


def replace_documents(spans: DataFrame, new: DataFrame, key: str, body: str, most: int = 800, least: int = 200) -> DataFrame:
    """A table of chunks after documents were put in: those of replaced documents go, the new ones' come."""
    cut = documents.chunks(new, key, body, most, least)
    kept = spans.join(new.select(key).distinct(), key, "left_anti")
    return kept.unionByName(cut.select(*kept.columns))


def replace_members(members: DataFrame, new: DataFrame, thread: str) -> DataFrame:
    """A membership table after some threads were written anew: all their old rows go."""
    kept = members.join(new.select(thread).distinct(), thread, "left_anti")
    return kept.unionByName(new.select(*kept.columns))


def pins_after(changes: DataFrame, item: str, ts: str, key: str) -> DataFrame:
    """Pins that a log of changes ``(item, ts, key, pinned, ...)`` leaves: the latest change of each item, unless it unpins."""
    w = Window.partitionBy(item).orderBy(F.desc(ts), F.desc(key))
    return changes.withColumn("_n", F.row_number().over(w)).where("_n = 1 and pinned").drop("_n", "pinned")
