"""Functions over structured values: boxes, JSON, claims, code blocks, declared types."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.spans import bound
from pyspark.sql import types as T

# --- boxes -----------------------------------------------------------------------------------


def box(values: Column) -> Column:
    """``struct(x0, y0, x1, y1)`` of an array with two corners or a polygon of points; null for other lengths."""
    xs = F.filter(values, lambda _, i: i % 2 == 0)
    ys = F.filter(values, lambda _, i: i % 2 == 1)
    corners = F.struct(
        F.array_min(xs).cast("int").alias("x0"), F.array_min(ys).cast("int").alias("y0"),
        F.array_max(xs).cast("int").alias("x1"), F.array_max(ys).cast("int").alias("y1"),
    )
    return F.when(F.size(values).isin(4, 8), corners)


def unit_box(b: Column, width: Column, height: Column) -> Column:
    """A box over the frame's size, held to [0, 1], six decimals."""

    def share(x: Column, size: Column) -> Column:
        return F.round(F.least(F.greatest(x / size, F.lit(0.0)), F.lit(1.0)), 6)

    return F.struct(
        share(b["x0"], width).alias("x0"), share(b["y0"], height).alias("y0"),
        share(b["x1"], width).alias("x1"), share(b["y1"], height).alias("y1"),
    )


def overlaps(a: Column, b: Column) -> Column:
    """Whether two boxes share area."""
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def tiles(width: Column, height: Column, columns: int, rows: int) -> Column:
    """Boxes of a grid over a frame, row by row; the last ones end at the frame's edge."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(columns * rows - 1)),
        lambda i: F.struct(
            F.floor((i % columns) * width / columns).cast("int").alias("x0"),
            F.floor(F.floor(i / columns) * height / rows).cast("int").alias("y0"),
            F.floor((i % columns + 1) * width / columns).cast("int").alias("x1"),
            F.floor((F.floor(i / columns) + 1) * height / rows).cast("int").alias("y1"),
        ),
    )


# --- JSON ------------------------------------------------------------------------------------


def _flat(value, path: str = ""):
    if isinstance(value, dict):
        for k in sorted(value):
            yield from _flat(value[k], f"{path}.{k}" if path else str(k))
    else:
        yield path, json.dumps(value, sort_keys=True, ensure_ascii=False)


_CHANGE = T.StructType([T.StructField(n, T.StringType()) for n in ("op", "path", "old", "new")])


@F.pandas_udf(T.ArrayType(_CHANGE))
def json_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """Structural difference of two JSON objects by dotted path: added, removed, changed."""

    def one(a, b):
        a, b = (dict(_flat(json.loads(x))) if x else {} for x in (a, b))
        out = []
        for path in sorted(a.keys() | b.keys()):
            if a.get(path) != b.get(path):
                op = "add" if path not in a else "remove" if path not in b else "change"
                out.append({"op": op, "path": path, "old": a.get(path), "new": b.get(path)})
        return out

    return pd.Series([one(a, b) for a, b in zip(old, new)])


@F.pandas_udf(T.StringType())
def json_merge(base: pd.Series, over: pd.Series) -> pd.Series:
    """Deep merge of two JSON objects; what the second has wins, objects merge, keys are sorted."""

    def both(a, b):
        if isinstance(a, dict) and isinstance(b, dict):
            return {k: both(a[k], b[k]) if k in a and k in b else b.get(k, a.get(k)) for k in a.keys() | b.keys()}
        return b

    def one(a, b):
        merged = both(json.loads(a) if a else {}, json.loads(b) if b else {})
        return json.dumps(merged, sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    return pd.Series([one(a, b) for a, b in zip(base, over)])


def frame_size(payload: Column) -> Column:
    """``struct(width, height)`` from the first place of a JSON payload that has them."""
    places = ("$.frame", "$.screen", "$")
    width = F.coalesce(*(F.get_json_object(payload, f"{p}.width") for p in places)).cast("int")
    height = F.coalesce(*(F.get_json_object(payload, f"{p}.height") for p in places)).cast("int")
    return F.struct(width.alias("width"), height.alias("height"))


def iso_time(value: Column) -> Column:
    """A timestamp from ISO 8601 text; without a zone it is UTC, what doesn't parse is null."""
    zoned = value.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$")
    return F.when(zoned, value).otherwise(F.concat(value, F.lit("Z"))).try_cast("timestamp")


def iso_text(when: Column) -> Column:
    """ISO 8601 text of a timestamp in UTC, with microseconds where it has some."""
    utc = F.to_utc_timestamp(when, F.current_timezone())
    whole = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.pmod(F.unix_micros(when), F.lit(1_000_000))
    digits = F.when(part > 0, F.concat(F.lit("."), F.lpad(part.cast("string"), 6, "0"))).otherwise(F.lit(""))
    return F.concat(whole, digits, F.lit("+00:00"))


#: Declared types and what they are here (a closed set).
DTYPES = {"text": "string", "integer": "bigint", "real": "double", "blob": "binary", "json": "string"}


def coerce(value: Column, dtype: str) -> Column:
    """A value as its declared type; null where it can't be."""
    if dtype not in DTYPES:
        raise ValueError(f"unknown type {dtype!r}")
    return value.try_cast(DTYPES[dtype])


def declared_schema(columns: Mapping[str, str]) -> str:
    """Spark DDL of a declared table."""
    unknown = sorted(set(columns.values()) - DTYPES.keys())
    if unknown:
        raise ValueError(f"unknown types {unknown}")
    return ", ".join(f"`{name}` {DTYPES[t]}" for name, t in columns.items())


@F.pandas_udf(T.StringType())
def thread_uuid(key: pd.Series) -> pd.Series:
    """Name-based identifier of a thread key."""
    return key.map(lambda x: str(uuid.uuid5(uuid.NAMESPACE_URL, x)), na_action="ignore")


# --- code and claims ---------------------------------------------------------------------------


def code_blocks(text: Column) -> Column:
    """``array<struct<language, body>>`` of fenced blocks."""
    fence = r"(?s)```([A-Za-z0-9_+-]*)[ \t]*\n(.*?)```"
    names = F.regexp_extract_all(text, F.lit(fence), F.lit(1))
    bodies = F.regexp_extract_all(text, F.lit(fence), F.lit(2))
    return F.transform(F.arrays_zip(names.alias("n"), bodies.alias("b")), lambda x: F.struct(x["n"].alias("language"), x["b"].alias("body")))


#: Words that begin a statement, and the tokens of SQL: strings, quoted names, comments, words, numbers, signs.
SQL_OPERATIONS = ("SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP", "WITH")
_SQL_TOKEN = r"""(?s)'(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`|--[^\n]*|/\*.*?\*/|[A-Za-z_][\w.$]*|[0-9][\w.]*|\S"""


def sql_statements(text: Column) -> Column:
    """``array<struct<operation, tables>>`` of the SQL statements in a text.

    Statements end at semicolons outside strings, quoted names and comments; the last one needs none. Tables are
    the names after FROM, JOIN, INTO, UPDATE and TABLE, each once, without the names of a WITH clause. Quoted
    names lose their quotes. What doesn't begin with a statement's keyword is left out.
    """
    tokens = F.filter(F.regexp_extract_all(text, F.lit(_SQL_TOKEN), F.lit(0)), lambda t: ~t.rlike(r"^(--|/\*)"))

    def cut(all_tokens: Column) -> Column:
        ends = F.filter(F.transform(all_tokens, lambda t, i: F.when(t == ";", i + 1).otherwise(0)), lambda i: i > 0)
        ends = F.concat(ends, F.array(F.size(all_tokens) + 1))
        return bound(ends, lambda e: F.transform(e, lambda end, k: _statement(all_tokens, F.coalesce(F.get(e, k - 1), F.lit(0)), end)))

    return F.filter(bound(tokens, cut), lambda s: s["operation"].isin(*SQL_OPERATIONS))


def _statement(tokens: Column, begin: Column, end: Column) -> Column:
    """The statement between two ends (places from 1, both exclusive)."""

    def read(own: Column) -> Column:
        word = lambda i: F.upper(F.coalesce(F.get(own, i), F.lit("")))
        name = lambda t: F.regexp_replace(t, r"^[\"`]|[\"`]$", "")
        named = F.transform(own, lambda t, i: F.when(word(i - 1).isin("FROM", "JOIN", "INTO", "UPDATE", "TABLE") & t.rlike(r"^[A-Za-z_\"`]"), name(t)))
        common = F.transform(
            own, lambda t, i: F.when((word(i + 1) == "AS") & (word(i + 2) == "(") & word(i - 1).isin("WITH", "RECURSIVE", ","), F.lower(name(t)))
        )
        tables = bound(F.array_compact(common), lambda c: F.array_distinct(F.filter(F.array_compact(named), lambda t: ~F.array_contains(c, F.lower(t)))))
        return F.struct(word(F.lit(0)).alias("operation"), tables.alias("tables"))

    return bound(F.slice(tokens, begin + 1, F.greatest(end - begin - 1, F.lit(0))), read)


CLAIMS = "struct<claims:array<struct<text:string,evidence:array<struct<id:string,first:int,last:int>>>>>"


def claims(payload: Column) -> Column:
    """Claims of a JSON answer, with ids C1, C2, ..."""
    parsed = F.from_json(payload, CLAIMS)["claims"]
    return F.transform(
        parsed,
        lambda c, i: F.struct(
            F.concat(F.lit("C"), (i + 1).cast("string")).alias("id"), c["text"].alias("text"), c["evidence"].alias("evidence")
        ),
    )


def valid_claim(claim: Column, lines: Column) -> Column:
    """Whether a claim has text and evidence, and all its line ranges lie within the evidence's lines (a map)."""
    inside = F.forall(
        claim["evidence"],
        lambda e: F.coalesce(
            (e["first"] >= 1) & (e["first"] <= e["last"]) & (e["last"] <= F.try_element_at(lines, e["id"])), F.lit(False)
        ),
    )
    return F.coalesce((F.trim(claim["text"]) != "") & (F.size(claim["evidence"]) > 0) & inside, F.lit(False))


def line_offsets(text: Column) -> Column:
    """0-based offset of every line of a text."""
    lengths = F.transform(F.split(text, "\n"), lambda x: F.length(x) + 1)
    start = F.array(F.lit(0))
    upto = F.aggregate(lengths, start, lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n)))
    return F.slice(upto, 1, F.size(lengths))


def join_lines(lines: Column) -> Column:
    """``struct(text, spans)``: lines joined by line feeds, and each one's key S1, S2, ... with its offsets."""
    joined = F.array_join(lines, "\n")
    spans = F.transform(
        line_offsets(joined),
        lambda at, i: F.struct(
            F.concat(F.lit("S"), (i + 1).cast("string")).alias("key"), at.alias("start"),
            (at + F.length(F.get(F.split(joined, "\n"), i))).alias("end"),
        ),
    )
    return F.struct(joined.alias("text"), spans.alias("spans"))


def contains_all(values: Column, wanted: Sequence[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), values)) == 0
