"""Score arithmetic: normalisation, decay, weighted mixtures. Every time is an argument."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def min_max(score: Column, by: str, *more: str) -> Column:
    """Score on [0, 1] within a partition; 1 where all are equal. Over all rows: with_bounds."""
    w = Window.partitionBy(by, *more)
    return between(score, F.min(score).over(w), F.max(score).over(w))


def with_bounds(rows: DataFrame, **columns: str) -> DataFrame:
    """rows with ``<name>_low`` and ``<name>_high``: least and greatest value of a column over all rows.

    A one-row aggregate beside the rows, so that no task holds them all.
    """
    ends = [
        f(c).alias(f"{name}_{end}") for name, c in columns.items() for end, f in (("low", F.min), ("high", F.max))
    ]
    return rows.join(F.broadcast(rows.agg(*ends)))  # one row


def between(score: Column, low: Column, high: Column) -> Column:
    """Score on [0, 1] between two bounds; 1 where they are equal."""
    return F.when(high == low, F.lit(1.0)).otherwise((score - low) / (high - low))


def age_seconds(when: Column, as_of: Column) -> Column:
    """Seconds from when to as_of, not below 0."""
    return F.greatest(F.unix_micros(as_of) / 1e6 - F.unix_micros(when) / 1e6, F.lit(0.0))


def recency(when: Column, as_of: Column, hours: float = 72.0) -> Column:
    return F.exp(-age_seconds(when, as_of) / (3600.0 * hours))


def half_life(value: Column, seconds: Column, half: float) -> Column:
    """value after a time, given the time in which it halves."""
    return value * F.pow(F.lit(2.0), -seconds / half)


def weighted(scores: Mapping[str, tuple[Column, float]], optional: Sequence[str] = ()) -> Column:
    """Weighted mean; an optional score joins the weights only in rows where it is positive."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, (score, w) in scores.items():
        score = F.coalesce(score, F.lit(0.0))
        total = total + score * w
        weight = weight + (F.when(score > 0, w).otherwise(0.0) if name in optional else F.lit(w))
    return F.when(weight > 0, total / weight).otherwise(F.lit(0.0))


def bm25_weight(tf: Column, length: Column, mean_length: Column, n_docs: Column, df: Column) -> Column:
    """One term's share of a document's score (k1 = 1.2, b = 0.75), positive is better."""
    odds = (n_docs - df + 0.5) / (df + 0.5)
    idf = F.when(F.log(odds) > 0, F.log(odds)).otherwise(F.lit(1e-6))
    return idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))


def lexical_score(bm25: Column, mode: str = "monotone") -> Column:
    """bm25 on (0, 1): ``monotone`` grows with it; ``inverted`` gives the best hit the least score."""
    if mode == "inverted":
        return 1 / (1 + F.abs(bm25))
    return F.abs(bm25) / (1 + F.abs(bm25))
