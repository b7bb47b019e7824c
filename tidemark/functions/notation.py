"""An object notation that is shorter than JSON: lists of like objects name their fields once, in a header.

The header has a line ``class Name { field ... }`` for each class used, a blank line follows,
then the value: JSON with blanks inside brackets, keys in a fixed order, and
``Name(value, ...)`` for objects of a class.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The order of known fields, and which lists hold which class.
FIELDS = {
    "ContextPack": ("version", "query", "generated_at", "evidence", "warnings"),
    "EvidenceItem": ("id", "ts_start", "ts_end", "source", "title", "text", "meta"),
    "EvidenceSpan": ("span_id", "start", "end", "conf", "bbox", "bbox_norm"),
}
LISTS = {"evidence": "EvidenceItem", "spans": "EvidenceSpan"}


def _in_order(keys, known: tuple[str, ...] = ()) -> list[str]:
    """Known fields first, the others by name."""
    place = {k: i for i, k in enumerate(known)}
    return sorted(keys, key=lambda k: (place.get(k, len(place)), k))


def encode(value) -> str:
    """A JSON value in the notation."""
    classes: dict[str, list[str]] = {}

    def body(x, inside: str | None = None) -> str:
        if isinstance(x, dict):
            pack = FIELDS["ContextPack"]
            keys = _in_order(x, pack if set(pack) <= x.keys() else ())
            return "{ " + ", ".join(f"{json.dumps(k)}: {body(x[k], k)}" for k in keys) + " }"
        if not isinstance(x, list):
            return json.dumps(x if x is None or isinstance(x, (str, bool, int, float)) else str(x))
        name = LISTS.get(inside)
        alike = bool(x) and all(isinstance(i, dict) and i.keys() == x[0].keys() for i in x)
        if name is None or not alike:
            return "[ " + ", ".join(map(body, x)) + " ]"
        keys = _in_order(x[0], FIELDS[name])
        classes.setdefault(name, keys)
        return "[ " + ", ".join(f"{name}(" + ", ".join(body(i[k]) for k in keys) + ")" for i in x) + " ]"

    whole = body(value)
    header = [f"class {name} {{ {' '.join(keys)} }}" for name, keys in sorted(classes.items())]
    return "\n".join([*header, "", whole]) if header else whole


_CLASS = re.compile(r"\s*class\s+([A-Za-z_]\w*)\s*\{([^}]*)\}\s*", re.ASCII)
_MARK = re.compile(r'\s*(?:([{}\[\](),:])|("(?:[^"\\]|\\.)*")|(-?[\d][\d+\-.eE]*)|([A-Za-z_$][\w.\-]*))', re.ASCII | re.DOTALL)


def decode(text: str):
    """The value that a text in the notation, or in JSON, stands for. ValueError where it stands for none."""
    if not text.strip():
        raise ValueError("nothing to decode")
    try:
        return json.loads(text)
    except ValueError:
        pass
    classes, lines = {}, text.split("\n")
    while lines and (not lines[0].strip() or _CLASS.fullmatch(lines[0])):
        found = _CLASS.fullmatch(lines.pop(0))
        if found:
            classes[found[1]] = found[2].split()
    source = "\n".join(lines).strip()
    marks, at = [], 0
    while at < len(source):
        found = _MARK.match(source, at)
        if not found:
            raise ValueError(f"unexpected {source[at:at + 10]!r}")
        marks.append(found.groups())
        at = found.end()
    marks.reverse()

    def ahead(sign: str) -> bool:
        return bool(marks) and marks[-1][0] == sign

    def take():
        if not marks:
            raise ValueError("unexpected end")
        return marks.pop()

    def many(end: str, one) -> list:
        out = []
        while not ahead(end):
            out.append(one())
            if ahead(","):
                take()
        take()
        return out

    def pair():
        _, quoted, _, bare = take()
        if quoted is None and bare is None:
            raise ValueError("a key is missing")
        if take()[0] != ":":
            raise ValueError("a colon is missing")
        return (json.loads(quoted) if quoted else bare), value()

    def value():
        sign, quoted, number, bare = take()
        if quoted or number:
            return json.loads(quoted or number)
        if sign == "{":
            return dict(many("}", pair))
        if sign == "[":
            return many("]", value)
        if bare in ("true", "false", "null"):
            return json.loads(bare)
        if bare and ahead("("):
            take()
            given = many(")", value)
            if not classes.get(bare):
                raise ValueError(f"unknown class {bare}")
            return {k: given[i] if i < len(given) else None for i, k in enumerate(classes[bare])}
        if bare:
            return bare
        raise ValueError(f"unexpected {sign!r}")

    return value()


@F.pandas_udf(T.StringType())
def encoded(payload: pd.Series) -> pd.Series:
    """JSON text in the notation."""
    return payload.map(lambda x: encode(json.loads(x)), na_action="ignore")


@F.pandas_udf(T.StringType())
def decoded(payload: pd.Series) -> pd.Series:
    """JSON text (keys sorted) of a value in the notation."""
    return payload.map(lambda x: json.dumps(decode(x), sort_keys=True, separators=(",", ":")), na_action="ignore")
