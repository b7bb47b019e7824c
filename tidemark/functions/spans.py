"""Ranges of a text that patterns match, and texts with the ranges replaced: Column expressions only.

Spark finds what a pattern matches and what lies between, but not where; places are the running sum of the
lengths of both. Patterns are Java's (write ``(?U)`` for Unicode classes) and never match the empty
string. Ranges count characters from 0, ends are exclusive. Work in a text grows with its number of
matches squared, as arrays grow by copies: a hundred thousand matches in one text take seconds.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def replaced(text: Column, pattern: str, instead: Callable[[Column], Column]) -> Column:
    """text with every match replaced by what ``instead`` makes of it."""
    given = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), instead)
    between = F.split(text, pattern, -1)
    parts = F.zip_with(between, F.concat(given, F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    return F.array_join(parts, "")


_RANGES = "array<struct<start:int, end:int, value:string>>"


def matches(text: Column, pattern: str, holding: str | None = None) -> Column:
    """Ranges ``(start, end, value)`` of all matches of a pattern, in order; none where the text is null.

    ``holding`` names characters that every match holds: texts without them aren't matched. A text
    without a match is gone through once, another one twice.
    """
    none = F.array().cast(_RANGES)

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + x["skip"]
        end = begin + F.length(x["value"])
        here = F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(here)).alias("out"))

    def placed(found: Column) -> Column:
        # What follows the last match is left out.
        pairs = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda a, v: F.struct(F.length(a).alias("skip"), v.alias("value")))
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.when(F.size(found) > 0, F.aggregate(pairs, start, step, lambda s: s["out"])).otherwise(none)

    out = bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    return out if holding is None else F.when(F.contains(text, F.lit(holding)), out).otherwise(none)


def clear_of(ranges: Column, others: Column) -> Column:
    """The ranges that overlap none of others."""
    return F.filter(ranges, lambda r: ~F.exists(others, lambda o: (o["start"] < r["end"]) & (r["start"] < o["end"])))


def by_precedence(text: Column, patterns: Sequence[tuple[str, str]], holding: Mapping[str, str] | None = None) -> Column:
    """Ranges ``(start, end, kind, value)`` of named patterns in order; what overlaps a match of an earlier pattern is left out.

    ``holding`` names characters that every match of a kind holds (see matches).
    """
    needed = holding or {}

    def named(ranges: Column, kind: str) -> Column:
        return F.transform(ranges, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), F.lit(kind).alias("kind"), r["value"].alias("value")))

    def add(held: Column, rest: Sequence[tuple[str, str]]) -> Column:
        if not rest:
            return F.array_sort(held)
        (kind, pattern), *more = rest
        own = named(clear_of(matches(text, pattern, needed.get(kind)), held), kind)
        return bound(F.concat(held, own), lambda h: add(h, more))

    (kind, pattern), *more = patterns
    return bound(named(matches(text, pattern, needed.get(kind)), kind), lambda held: add(held, more))


def merged(text: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    """Ranges ``(start, end, kind)`` in which matches of named patterns overlap, named after the one that begins first.

    Of two that begin together the longer one gives its name, then the first in code-point order.
    """
    every = F.concat(*(_kind_first(matches(text, p), kind) for kind, p in patterns))

    def step(out: Column, r: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], -r["minus"]).alias("end"), last["kind"].alias("kind"))
        fresh = F.struct(r["start"].alias("start"), (-r["minus"]).alias("end"), r["kind"].alias("kind"))
        joins = (F.size(out) > 0) & (r["start"] < last["end"])
        return F.when(joins, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(grown))).otherwise(F.concat(out, F.array(fresh)))

    return F.aggregate(F.array_sort(every), F.array().cast("array<struct<start:int, end:int, kind:string>>"), step)


def _kind_first(ranges: Column, kind: str) -> Column:
    return F.transform(ranges, lambda r: F.struct(r["start"].alias("start"), (-r["end"]).alias("minus"), F.lit(kind).alias("kind")))


def with_tokens(text: Column, ranges: Column) -> Column:
    """text with the ranges, in order and apart, replaced by their ``token``."""
    before = lambda i: F.coalesce(F.get(ranges, i - 1)["end"], F.lit(0))
    parts = F.transform(ranges, lambda r, i: F.concat(F.substring(text, before(i) + 1, r["start"] - before(i)), r["token"]))
    tail = F.substring(text, before(F.size(ranges)) + 1, F.length(text))
    return F.array_join(F.concat(parts, F.array(tail)), "")


def moved(ranges: Column) -> Column:
    """Ranges ``(start, end, new_start, new_end, kind, token, value)``: where each one's token is once all are replaced."""
    kind = "array<struct<start:int, end:int, new_start:int, new_end:int, kind:string, token:string, value:string>>"

    def step(s: Column, r: Column) -> Column:
        begin = r["start"] + s["shift"]
        end = begin + F.length(r["token"])
        here = F.struct(
            r["start"].alias("start"), r["end"].alias("end"), begin.alias("new_start"), end.alias("new_end"),
            r["kind"].alias("kind"), r["token"].alias("token"), r["value"].alias("value"),
        )
        return F.struct((end - r["end"]).alias("shift"), F.concat(s["out"], F.array(here)).alias("out"))

    start = F.struct(F.lit(0).alias("shift"), F.array().cast(kind).alias("out"))
    return F.aggregate(ranges, start, step, lambda s: s["out"])
