"""Browsing: filters, keyset pages, facets, suggestions, range scans, retention predicates."""

from __future__ import annotations

import base64
import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import like_pattern


@dataclass(frozen=True)
class EventFilter:
    """A bundle of filters over an events table; what is unset filters nothing.

    Substrings are found without regard to case and ``%`` and ``_`` in them keep
    their meaning for LIKE.
    """

    start: object = None
    end: object = None
    equals: tuple[tuple[str, tuple], ...] = ()
    contains: tuple[tuple[str, str], ...] = ()
    present: tuple[tuple[str, bool], ...] = ()
    time: str = "ts"

    def column(self) -> Column:
        out = F.lit(True)
        if self.start is not None:
            out = out & (F.col(self.time) >= F.lit(self.start).cast("timestamp"))
        if self.end is not None:
            out = out & (F.col(self.time) <= F.lit(self.end).cast("timestamp"))
        for name, values in self.equals:
            if values:
                out = out & F.col(name).isin(*values)
        for name, part in self.contains:
            out = out & F.lower(F.col(name)).like(f"%{part.lower()}%")
        for name, wanted in self.present:
            out = out & (F.col(name).isNotNull() if wanted else F.col(name).isNull())
        return out


def encode_cursor(ts: str, event_id) -> str:
    raw = json.dumps({"ts": ts, "id": event_id}, separators=(",", ":")).encode()
    return base64.urlsafe_b64encode(raw).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple[str, object]:
    got = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    return got["ts"], got["id"]


def page(
    events: DataFrame, where: EventFilter, limit: int = 100, cursor: str | None = None,
    descending: bool = True, key: str = "event_id",
) -> DataFrame:
    """One page in (time, id) order after a cursor; the limit is held to 1..500.

    The cursor is a predicate, so a page costs the same however deep it is.
    """
    rows, ts = events.where(where.column()), where.time
    if cursor is not None:
        at, last = decode_cursor(cursor)
        at, last = F.lit(at).cast("timestamp"), F.lit(last)
        before = (F.col(ts) < at) | ((F.col(ts) == at) & (F.col(key) < last))
        after = (F.col(ts) > at) | ((F.col(ts) == at) & (F.col(key) > last))
        rows = rows.where(before if descending else after)
    order = [F.col(c).desc() if descending else F.col(c).asc() for c in (ts, key)]
    return rows.orderBy(*order).limit(min(max(limit, 1), 500))


def facets(rows: DataFrame, column: str, limit: int = 50) -> DataFrame:
    """``(value, n)``: counts by value, largest first; empty values go after the limit."""
    counted = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value"))
    top = counted.agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(limit)
    return top.where(F.col("value") != "")


def status_counts(rows: DataFrame, **conditions: Column) -> DataFrame:
    """One row of conditional counts in one pass."""
    return rows.agg(*(F.count_if(c).alias(name) for name, c in conditions.items()))


def range_scan(
    rows: DataFrame, start: str, end: str, ts: str = "ts", key: str = "event_id", limit: int = 100, offset: int = 0
) -> DataFrame:
    """Rows of an inclusive time range, newest first, with the constant score of a scan."""
    inside = rows.where(F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    return inside.orderBy(F.desc(ts), F.desc(key)).offset(offset).limit(limit).withColumn("score", F.lit(0.4))


def substring_search(rows: DataFrame, columns: Sequence[str], query: str, key: str, limit: int = 100) -> DataFrame:
    """Fallback search: rows that hold query literally in any column, with the score of a scan."""
    pattern = like_pattern(query.lower())
    joined = F.lower(F.concat_ws("\n", *(F.coalesce(F.col(c), F.lit("")) for c in columns)))
    return rows.where(joined.like(pattern)).orderBy(key).limit(limit).withColumn("score", F.lit(0.4))


def query_history(log: DataFrame, text: str = "text", ts: str = "ts") -> DataFrame:
    """``(normalised, uses, last_used, latest)`` for each distinct normalised query."""
    key = F.trim(F.regexp_replace(F.lower(F.col(text)), r"\s+", " "))
    return log.groupBy(key.alias("normalised")).agg(
        F.count("*").alias("uses"), F.max(ts).alias("last_used"), F.max_by(text, ts).alias("latest")
    )


def suggest(history: DataFrame, prefix: str, as_of, newest: int = 30, top: int = 8) -> DataFrame:
    """Completions of a prefix: among the newest matches, by use and age."""
    match = history.where(F.col("normalised").startswith(prefix.lower()))
    recent = match.orderBy(F.desc("last_used"), "normalised").limit(newest)
    hours = F.greatest(
        (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("last_used")) / 3.6e9, F.lit(0.0)
    )
    score = F.round(1 + 0.3 * F.sqrt("uses") + 0.3 / (1 + hours), 6)
    return recent.withColumn("score", score).orderBy(F.desc("score"), "normalised").limit(top)


def delete_preview(tables: dict[str, tuple[DataFrame, str]], start: str, end: str) -> DataFrame:
    """``(name, n)``: rows of each table within one inclusive range."""
    out = None
    for name, (rows, ts) in sorted(tables.items()):
        inside = F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
        one = rows.agg(F.count_if(inside).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def retention_split(
    rows: DataFrame, as_of, days: int, protect_minutes: int = 60, ts: str = "ts", safe: Column | None = None
) -> DataFrame:
    """rows with ``expired``: older than the limit, not protected as recent, in a safe state."""
    now = F.lit(as_of).cast("timestamp")
    old = F.col(ts) < now - F.make_interval(days=F.lit(days))
    protected = F.col(ts) >= now - F.make_interval(mins=F.lit(protect_minutes))
    return rows.withColumn("expired", old & ~protected & (F.lit(True) if safe is None else safe))


def quota_prune(rows: DataFrame, size: str, quota: int, ts: str, key: str) -> DataFrame:
    """rows with ``over``: what must go, oldest first, for the rest to fit into a quota.

    Rows are kept while the running total from the newest stays within the quota.
    The total over days comes first, so only one day's rows are ordered in a task.
    """
    day = rows.withColumn("_day", F.to_date(ts))
    days = day.groupBy("_day").agg(F.sum(size).alias("_n"))
    newer = Window.orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)
    starts = days.select("_day", F.coalesce(F.sum("_n").over(newer), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_day").orderBy(F.desc(ts), F.desc(key))
    total = F.col("_start") + F.sum(size).over(within.rowsBetween(Window.unboundedPreceding, 0))
    return day.join(starts, "_day").withColumn("over", total > quota).drop("_day", "_start")


def daily_rollup(rows: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """``(day, n)`` for every day of a range, days without rows included."""
    days = rows.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day")
    )
    counted = rows.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    return days.join(counted, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))
