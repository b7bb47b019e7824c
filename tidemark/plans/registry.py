"""Registration of named queries with their oracle SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with DuckDB SQL where SQL can express it."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def hmac_sql(value: str, secret: str) -> str:
    """DuckDB SQL of a text's HMAC-SHA256 in hex, for secrets of 64 bytes at most."""
    inner, outer = (bytes(b ^ pad for b in secret.encode().ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({value}))))"


def ranges_sql(name: str, rows: str, patterns: dict[str, str]) -> str:
    """DuckDB CTEs ending in ``name``: ``(doc_id, kind, s, e, value)`` of what patterns match in ``(doc_id, text)`` rows."""
    each = " UNION ALL ".join(
        f"SELECT doc_id, '{kind}' AS kind, string_split_regex(text, '{p}') AS gap, regexp_extract_all(text, '{p}') AS hit FROM {rows}" for kind, p in patterns.items()
    )
    before = "list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hit[1:i - 1], lambda x: length(x))), 0)"
    return f"""{name}_all AS ({each}), {name}_at AS (SELECT *, unnest(range(1, len(hit) + 1)) AS i FROM {name}_all WHERE len(hit) > 0),
{name} AS (SELECT doc_id, kind, ({before})::BIGINT AS s, ({before})::BIGINT + length(hit[i]) AS e, hit[i] AS value FROM {name}_at)"""


def micros(column: str | Column) -> Column:
    """A timestamp as whole microseconds, which engines hash alike."""
    return F.unix_micros(column)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir``.

    Where that is unset a temporary folder serves, but only on one machine.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not base and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = base or tempfile.mkdtemp(prefix="tidemark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
