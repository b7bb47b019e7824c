"""Table changes as pure functions from old rows to new rows; a table format or an overwrite makes them durable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_wins(old: DataFrame, new: DataFrame, key: list[str], *newest: Column) -> DataFrame:
    """Upsert: for each key the newest row; at a tie the new one."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(*newest, F.desc("_side"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_side")


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows and those new rows whose key isn't there."""
    fresh = new.dropDuplicates(key).join(old.select(*key), key, "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def keep_newest(rows: DataFrame, by: str, n: int, *order: Column) -> DataFrame:
    """The n newest rows of each key; cut within every task before the shuffle."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def promote(items: DataFrame, key: str, *newest: Column) -> DataFrame:
    """items with ``state``: of each key's sourced items the newest is active, others are deprecated."""
    w = Window.partitionBy(key).orderBy(F.desc("sourced"), *newest)
    first = (F.row_number().over(w) == 1) & F.col("sourced")
    return items.withColumn(
        "state", F.when(first, "active").when(F.col("sourced"), "deprecated").otherwise("proposed")
    )


def delete_range(rows: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Rows outside an inclusive range."""
    inside = F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    return rows.where(~F.coalesce(inside, F.lit(False)))


def cascade(children: DataFrame, key: str, deleted: DataFrame, parent_key: str) -> DataFrame:
    """Children whose parent isn't among the deleted rows."""
    gone = deleted.select(F.col(parent_key).alias("_k")).distinct()
    return children.join(gone, F.col(key) == F.col("_k"), "left_anti")


def job_states(attempts: DataFrame, job: str, ts: str, most: int) -> DataFrame:
    """``(job, attempts, state)`` of a log of attempts with ``ok``: done, failed for good, or pending."""
    own = attempts.groupBy(job).agg(
        F.count("*").alias("attempts"), F.bool_or("ok").alias("done"), F.max(ts).alias("last")
    )
    state = F.when(F.col("done"), "done").when(F.col("attempts") >= most, "failed").otherwise("pending")
    return own.select(job, "attempts", state.alias("state"))


def verify_slices(spans: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """spans with ``valid``: the span's text is the slice of its document, and its hash matches."""
    joined = spans.join(texts.select(key, F.col("text").alias("_text")), key, "left")
    cut = F.substring(F.col("_text"), F.col("start") + 1, F.col("end") - F.col("start"))
    good = (cut == F.col("span_text")) & (F.sha2("span_text", 256) == F.col("span_hash"))
    return joined.withColumn("valid", F.coalesce(good, F.lit(False))).drop("_text")
