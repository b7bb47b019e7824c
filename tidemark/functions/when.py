"""Times that queries speak of, as ranges for a range scan, and windows and eligibility of the late stage."""

from __future__ import annotations

import datetime as dt
import re
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CLOCK = r"(?P<h>\d{1,2})(?::(?P<m>\d{2}))?\s*(?P<half>am|pm)?"
_LAST_HOUR = re.compile(r"(?:last|past) hour|an? hour ago")
#: Ways to name an hour of the day before.
_YESTERDAY = [re.compile(p) for p in (rf"yesterday {_CLOCK}", rf"(?:at )?{_CLOCK} yesterday")]

Range = tuple[dt.datetime, dt.datetime]


def _clean(query: str) -> str:
    return " ".join(query.lower().split())


def _hour_of(found: re.Match) -> dt.time | None:
    hour, minute = int(found["h"]), int(found["m"] or 0)
    if found["half"] == "pm" and hour < 12:
        hour += 12
    elif found["half"] == "am" and hour == 12:
        hour = 0
    return dt.time(hour, minute) if hour < 24 and minute < 60 else None


def time_range(query: str, now: dt.datetime, zone: str = "UTC") -> Range | None:
    """The range in UTC that a query names: the hour up to now, or an hour of yesterday in a zone."""
    words = _clean(query)
    if re.search(rf"\b(?:{_LAST_HOUR.pattern})\b", words):
        return now - dt.timedelta(hours=1), now
    for pattern in _YESTERDAY:
        found = re.search(rf"\b{pattern.pattern}\b", words)
        at = _hour_of(found) if found else None
        if at is not None:
            local = ZoneInfo(zone)
            day = now.astimezone(local).date() - dt.timedelta(days=1)
            start = dt.datetime.combine(day, at, tzinfo=local).astimezone(dt.timezone.utc)
            return start, start + dt.timedelta(hours=1)
    return None


def only_a_time(query: str) -> bool:
    """Whether a query is nothing but a time, so that a range scan answers it."""
    words = _clean(query)
    return any(p.fullmatch(words) for p in (_LAST_HOUR, *_YESTERDAY))


def late_window_allowed(found: Range | None, days: int = 7) -> bool:
    """Whether the late stage may come first: a range is given and no longer than some days (one at least)."""
    return found is not None and found[1] - found[0] <= dt.timedelta(days=max(1, days))


_SAID = T.StructType([T.StructField(n, t) for n, t in (("start", T.LongType()), ("end", T.LongType()), ("only_time", T.BooleanType()), ("late", T.BooleanType()))])


@F.pandas_udf(_SAID)
def said(query: pd.Series, now: pd.Series) -> pd.DataFrame:
    """For each query and its time the range that it names, in seconds since 1970 (null: none), and what may follow from it."""
    rows = []
    for words, at in zip(query.fillna(""), now):
        found = None if pd.isna(at) else time_range(words, at.to_pydatetime().replace(tzinfo=dt.timezone.utc))
        ends = (None, None) if found is None else tuple(int(x.timestamp()) for x in found)
        rows.append((*ends, only_a_time(words), late_window_allowed(found)))
    out = pd.DataFrame(rows, columns=["start", "end", "only_time", "late"])
    return out.astype({"start": "Int64", "end": "Int64", "only_time": bool, "late": bool})


def late_eligible(
    spans: DataFrame, event: str, ts: str, body: str, confidence: str, key: str, as_of: Column,
    days: int = 30, chars: int = 200, most: int = 128,
) -> DataFrame:
    """Spans that get late vectors: of recent events, short, and among the surest of their event."""
    recent = F.col(ts) >= as_of - F.make_interval(days=F.lit(days))
    rows = spans.where(recent & (F.length(body) <= chars))
    w = Window.partitionBy(event).orderBy(F.desc_nulls_last(confidence), key)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
