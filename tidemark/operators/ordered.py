"""Order-dependent values of keys of any size: time is cut into spans, and what a span needs of the ones before is carried.

A window over a whole key is one task's work, however many rows the key has. Here each
span of a key is a window of its own; the spans' last values or sums, one row for
each, are combined by a window over spans and joined back.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held(rows: DataFrame) -> DataFrame:
    """rows written to the checkpoint folder, for those who read them several times; as they are where a cluster has no folder."""
    sc = rows.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", "")
        if not named and sc.master.partition("[")[0] != "local":
            return rows
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return rows.checkpoint()


def span_of(ts: str, seconds: float) -> Column:
    """Number of the span of time that a row falls into."""
    return F.floor(F.unix_micros(ts) / int(seconds * 1e6)).cast("long")


def previous(rows: DataFrame, by: Sequence[str], ts: str, key: str, seconds: float, **columns: str) -> DataFrame:
    """rows with the values that columns had in the row before (by time, then key), as new columns."""
    names = list(columns)
    held = F.struct(*(F.col(columns[n]).alias(n) for n in names))
    spanned = rows.withColumn("_span", span_of(ts, seconds))
    order = Window.partitionBy(*by, "_span").orderBy(ts, key)
    near = spanned.withColumn("_near", F.lag(held).over(order))
    last = spanned.groupBy(*by, "_span").agg(F.max_by(held, F.struct(ts, key)).alias("_last"))
    carried = last.withColumn("_carried", F.lag("_last").over(Window.partitionBy(*by).orderBy("_span")))
    joined = near.join(carried.select(*by, "_span", "_carried"), [*by, "_span"], "left")
    before = F.coalesce("_near", "_carried")
    return joined.select(*rows.columns, *(before[n].alias(n) for n in names))


def running(rows: DataFrame, by: Sequence[str], ts: str, key: str, seconds: float, value: str, name: str) -> DataFrame:
    """rows with the running sum of a column up to each row, the row included."""
    spanned = rows.withColumn("_span", span_of(ts, seconds))
    order = Window.partitionBy(*by, "_span").orderBy(ts, key).rowsBetween(Window.unboundedPreceding, 0)
    near = spanned.withColumn("_near", F.sum(value).over(order))
    sums = spanned.groupBy(*by, "_span").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    start = sums.select(*by, "_span", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    joined = near.join(start, [*by, "_span"])
    return joined.select(*rows.columns, (F.col("_near") + F.col("_start")).alias(name))


def latest(rows: DataFrame, by: Sequence[str], ts: str, side: str, seconds: float, value: str, name: str) -> DataFrame:
    """rows with the last non-null value up to each row, by time and then side, the row included."""
    spanned = rows.withColumn("_span", span_of(ts, seconds))
    order = Window.partitionBy(*by, "_span").orderBy(ts, side).rowsBetween(Window.unboundedPreceding, 0)
    near = spanned.withColumn("_near", F.last(value, ignorenulls=True).over(order))
    last = spanned.where(F.col(value).isNotNull()).groupBy(*by, "_span").agg(
        F.max_by(F.struct(F.col(value).alias("v")), F.struct(ts, side)).alias("_last")
    )
    every = spanned.select(*by, "_span").distinct().join(last, [*by, "_span"], "left")
    before = Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select(*by, "_span", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    joined = near.join(carried, [*by, "_span"], "left")
    return joined.select(*rows.columns, F.coalesce("_near", F.col("_carried.v")).alias(name))


def rank_over_all(
    rows: DataFrame, score: str, name: str = "rank", buckets: int = 64, ties: Sequence[str] = (), rising: bool = False
) -> DataFrame:
    """rows with their rank by falling (or rising) score over all rows; equal scores share a rank, unless ``ties`` tells them apart.

    Scores are dealt to buckets by approximate quantiles, so no task orders all rows; a
    row's rank is its rank within the bucket after all rows of higher ones.
    """
    rows = held(rows)
    levels = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(rows.approxQuantile(score, levels, 0.25 / buckets)))
    bounds = F.array(*(F.lit(float(c)) for c in cuts)) if cuts else F.array().cast("array<double>")
    own = F.size(F.filter(bounds, lambda c: c <= F.col(score)))
    dealt = rows.withColumn("_bucket", own)
    counts = dealt.groupBy("_bucket").agg(F.count("*").alias("_n"))  # one row for each bucket
    falls = F.asc if rising else F.desc
    higher = Window.orderBy(falls("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    above = counts.select("_bucket", F.coalesce(F.sum("_n").over(higher), F.lit(0)).alias("_above"))
    order = Window.partitionBy("_bucket").orderBy(falls(score), *ties)
    within = (F.row_number() if ties else F.rank()).over(order)
    ranked = dealt.withColumn("_within", within).join(F.broadcast(above), "_bucket")
    return ranked.select(*rows.columns, (F.col("_within") + F.col("_above")).alias(name))


#: Groups whose bounds are handed to all tasks.
MOST_GROUPS = 1000


def exact_quantiles(
    rows: DataFrame, column: str, by: Sequence[str], levels: Sequence[float], accuracy: int = 2000
) -> DataFrame:
    """``(by, level, value)``: exact quantiles, interpolated linearly, of each group.

    A sketch, which is bounded and within ``1 / accuracy`` of each rank, gives two values
    that every wanted rank lies between. What lies below them is only counted, what
    lies between, a few thousandths of a group, is counted by value and ordered. Of a group
    of twice ``accuracy`` rows or fewer all are, since there a sketch may be off by a whole rank.
    """
    known = rows.where(F.col(column).isNotNull()).select(*by, F.col(column).cast("double").alias("_x"))
    slack = 2.5 / accuracy
    cuts = [min(1.0, max(0.0, q + d)) for q in levels for d in (-slack, slack)]
    bounds = known.groupBy(*by).agg(F.percentile_approx("_x", cuts, accuracy).alias("_c"), F.count("*").alias("_n"))
    few = bounds.limit(MOST_GROUPS + 1).collect()
    if len(few) <= MOST_GROUPS:  # counted, so every task gets them; of more groups none is large beside the others
        bounds = F.broadcast(rows.sparkSession.createDataFrame(few, bounds.schema))
    joined = known.join(bounds, list(by)) if by else known.join(bounds)
    small = F.col("_n") <= 2 * accuracy
    parts = F.array(
        *(
            # Of what lies below only one mark is left, so the partial counts take one row for each.
            F.when(
                small | (F.col("_x") <= F.col("_c")[2 * i + 1]),
                F.struct(
                    F.lit(float(q)).alias("level"),
                    F.when(small | (F.col("_x") >= F.col("_c")[2 * i]), F.col("_x")).alias("x"),
                ),
            )
            for i, q in enumerate(levels)
        )
    )
    each = joined.select(*by, "_n", F.explode(F.array_compact(parts)).alias("_p"))
    counted = each.groupBy(*by, "_p.level", "_p.x").agg(F.count("*").alias("_k"), F.first("_n").alias("_n"))
    upto = Window.partitionBy(*by, "level").orderBy(F.col("x").asc_nulls_first())
    ends = counted.withColumn("_end", F.sum("_k").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.col("level") * (F.col("_n") - 1)
    # The values at the ranks below and above: the first ones whose counts reach beyond them.
    low = F.min(F.when(F.col("x").isNotNull() & (F.col("_end") > F.floor(at)), F.col("x")))
    high = F.min(F.when(F.col("x").isNotNull() & (F.col("_end") > F.ceil(at)), F.col("x")))
    part = F.first(at - F.floor(at))
    return ends.groupBy(*by, "level").agg((low + (high - low) * part).alias("value"))
