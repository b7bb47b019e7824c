"""Interaction audit of five document filters over every order in which they can be applied.

Method: *inclusion-exclusion*. One pass turns each whole text into five failure
flags. Per part (language) the joint-failure counts ``J(S)`` of all 32 sets of
filters are sums of products of flags. Everything asked for follows from them by
Möbius inversion, whatever the number of documents:

* survivors of the filters in P: ``kept(P) = sum over T in P of (-1)^|T| J(T)``
* removed by f after P: ``kept(P) - kept(P + f)``; redundant: ``J(f)`` minus that
* failing f only: ``sum over T with f of (-1)^(|T|-1) J(T)``
* the Harsanyi dividend of T in the game "documents removed" is
  ``(-1)^(|T|+1) J(T)``; f's Shapley value shares it equally among T, and summed
  over all orders it is ``sum over T with f of (-1)^(|T|+1) J(T) * 5!/|T|``.

Filters (failure conditions): A fewer than 100 words; B distinct words below 80 %
of the words; C more than 10 % capital letters A-Z; D any of ``#$%&*|``; E a text
identical to one of a smaller id, table-wide.

E is decided on digests (SHA-256) alone: the smallest id of each digest comes from
one aggregate, and rows are joined with it on digest *and* id, so that a text which
a third of all rows share is dealt out like any other. Texts never leave the first pass.

Edge cases: a null text is the empty text (fails A only; with 0 words 0 < 0 is false);
null and empty texts are identical to each other; a null language is the part
``''``; a row without an id never fails E and has no labels; rows that repeat an id
and a text are separate rows, and none of those with the smallest id fails E; labels
that repeat count as set if any row sets them; an empty table gives no rows; other
columns are not looked at. Texts are gone through in slices of 2 MB.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, column, materialise, run_hashes, session_of, text_chunks

FILTERS = "ABCDE"
ALL = 1 << len(FILTERS)
#: Characters that filter D doesn't allow (fixed by the result contract).
SYMBOLS = b"#$%&*|"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10

_CAPITAL = np.zeros(256, bool)
_CAPITAL[ord("A") : ord("Z") + 1] = True


def failures(text: bytes) -> int:
    """Bits 0 to 3: whether a text fails A, B, C and D."""
    words = run_hashes(text)[2]
    n = len(words)
    capitals = points = 0
    whole = np.frombuffer(text, np.uint8)
    for at in range(0, len(whole), SLICE_BYTES):
        part = whole[at : at + SLICE_BYTES]
        capitals += int(np.count_nonzero(_CAPITAL[part]))
        points += int(np.count_nonzero((part & 0xC0) != 0x80))
    flags = (
        n < LEAST_WORDS,
        100 * len(np.unique(words)) < LEAST_DISTINCT * n,
        100 * capitals > MOST_CAPITALS * points,
        any(bytes((c,)) in text for c in SYMBOLS),
    )
    return sum(1 << k for k, failed in enumerate(flags) if failed)


def flagged(docs: DataFrame, key: str, part: str, text: str) -> DataFrame:
    """``(id, part, digest, bits)`` for every row of docs."""
    rows = docs.select(
        column(key).alias("id"), F.coalesce(column(part).cast("string"), F.lit("")).alias("part"), column(text).alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, 2):
            raw = [t.encode() for t in texts]
            digests = pa.array([hashlib.sha256(t).digest() for t in raw], pa.binary())
            bits = pa.array([failures(t) for t in raw], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), digests, bits], ["id", "part", "digest", "bits"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, part string, digest binary, bits int")


def _subsets(mask: int) -> list[int]:
    return [t for t in range(ALL) if t & mask == t]


def _signed(counts: str, masks: list[int], sign) -> str:
    """SQL of the sum over masks of ``sign(mask) * J(mask)``."""
    return " + ".join(f"({sign(t)}L * {counts}[{t}])" for t in masks)


def survivors(counts: str, mask: int) -> str:
    """Rows that fail none of the filters in mask, from the joint-failure counts."""
    return _signed(counts, _subsets(mask), lambda t: (-1) ** t.bit_count())


def unique_failures(counts: str, f: int) -> str:
    """Rows that fail filter number f and no other."""
    return _signed(counts, [t for t in range(ALL) if t >> f & 1], lambda t: (-1) ** (t.bit_count() - 1))


def shapley_sum(counts: str, f: int) -> str:
    """Filter f's removals summed over all orders: its shares of the Harsanyi dividends times 5!."""
    orders = math.factorial(len(FILTERS))
    return _signed(counts, [t for t in range(ALL) if t >> f & 1], lambda t: (-1) ** (t.bit_count() + 1) * orders // t.bit_count())


def _array(values) -> Column:
    return F.expr(f"array({', '.join(values)})")


def joint_failures(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", part: str = "lang", text: str = "text",
    good: str = "quality", toxic: str = "toxic",
) -> DataFrame:
    """``(part, joint, joint_good, joint_toxic)``: arrays of 32 counts of the rows that fail all filters of a mask.

    The three arrays count all rows, those labelled good and those labelled toxic.
    """
    session_of(docs)
    # Equal rows meet before any join, so neither repeated rows nor missing ids are hot there.
    rows = flagged(docs, key, part, text).groupBy("id", "part", "digest", "bits").agg(F.count("*").alias("n"))
    rows = materialise(rows)
    first = rows.where("id is not null").groupBy(F.col("digest").alias("first_digest")).agg(F.min("id").alias("first_id"))
    known = labels.where(column(key).isNotNull()).groupBy(column(key).cast("string").alias("label_of"))
    known = known.agg(F.max((column(good) == 1).cast("int")).alias("good"), F.max((column(toxic) == 1).cast("int")).alias("toxic"))
    # A row without an id joins by its digest, which is no label's id: such rows are dealt out too.
    joined = rows.withColumn("own", F.coalesce(F.col("id").cast("string"), F.concat(F.lit("-"), F.hex("digest"))))
    joined = joined.join(known, F.col("own") == F.col("label_of"), "left")
    joined = joined.join(first, (F.col("digest") == F.col("first_digest")) & (F.col("id") == F.col("first_id")), "left")
    again = F.col("id").isNotNull() & F.col("first_id").isNull()
    bits = F.col("bits").bitwiseOR(again.cast("int") * (1 << FILTERS.index("E")))
    patterns = joined.groupBy(
        "part", bits.alias("bits"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")
    ).agg(F.sum("n").alias("n"))  # at most 128 rows a part
    flags = patterns.select("part", "n", "good", "toxic", *(F.expr(f"bits >> {f} & 1L").alias(name) for f, name in enumerate(FILTERS)))

    def product(mask: int, measure: str) -> str:
        return f"sum({' * '.join([measure, *(name for f, name in enumerate(FILTERS) if mask >> f & 1)])})"

    measures = {"joint": "n", "joint_good": "n * good", "joint_toxic": "n * toxic"}
    sums = [_array(product(mask, m) for mask in range(ALL)).alias(name) for name, m in measures.items()]
    return flags.groupBy("part").agg(*sums)


def filter_audit(docs: DataFrame, labels: DataFrame, **names: str) -> DataFrame:
    """One row per part, order of the filters and step, with the counts that the module describes.

    ``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)``
    """
    joint = joint_failures(docs, labels, **names)
    counts = ("joint", "joint_good", "joint_toxic")
    tables = joint.select(
        "part",
        F.col("joint").alias("fails"),
        *(_array(survivors(c, mask) for mask in range(ALL)).alias(f"left_{c}") for c in counts),
        _array(unique_failures("joint", f) for f in range(len(FILTERS))).alias("alone"),
        _array(shapley_sum("joint", f) for f in range(len(FILTERS))).alias("share"),
    )
    steps = docs.sparkSession.createDataFrame(list(order_steps()), "filter_order string, step int, f int, before int, after int")
    placed = steps.select(F.collect_list(F.struct(*steps.columns)).alias("steps"))  # 600 rows, the same for all parts
    each = tables.join(F.broadcast(placed)).select("*", F.inline("steps"))
    lost = lambda c: F.col(f"left_{c}")[F.col("before")] - F.col(f"left_{c}")[F.col("after")]
    return each.select(
        "part", "filter_order", "step",
        F.col("left_joint")[F.col("after")].alias("kept"),
        lost("joint").alias("removed"),
        (F.col("fails")[F.col("after") - F.col("before")] - lost("joint")).alias("redundant"),
        F.col("alone")[F.col("f")].alias("unique_fails"),
        lost("joint_good").alias("good_lost"),
        lost("joint_toxic").alias("toxic_lost"),
        F.col("share")[F.col("f")].alias("shapley"),
    )


def order_steps() -> Iterator[tuple[str, int, int, int, int]]:
    """``(order, step, filter number, mask before, mask after)`` of all orders."""
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            yield "".join(FILTERS[k] for k in order), step, f, before, before | 1 << f
            before |= 1 << f


def oracle() -> str:
    """DuckDB SQL that applies the filters one after another, order by order."""
    orders = ", ".join(f"('{''.join(o)}')" for o in permutations(FILTERS))
    passed = " AND ".join(f"(p.step <= {k} OR NOT f[instr('{FILTERS}', substr(p.o, {k}, 1))])" for k in range(1, 5))
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels
  WHERE doc_id IS NOT NULL GROUP BY doc_id
), flags AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w),
          100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'),
          coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)] AS f
  FROM d LEFT JOIN l USING (doc_id)
), patterns AS (
  SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY part, f
), p AS (
  SELECT o, step FROM (VALUES {orders}) v(o), range(1, 6) r(step)
), steps AS (
  SELECT part, o, p.step, substr(o, p.step, 1) AS letter, n, good, toxic,
         f[instr('{FILTERS}', substr(o, p.step, 1))] AS fails, {passed} AS reached,
         len(list_filter(f, lambda x: x)) = 1 AS only_one
  FROM patterns, p
), counted AS (
  SELECT part, o AS filter_order, step::INT AS step, letter,
         sum(CASE WHEN reached AND NOT fails THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN reached AND fails THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN fails AND NOT reached THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN fails AND only_one THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN reached AND fails THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN reached AND fails THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM steps GROUP BY part, o, step, letter
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley
FROM counted
"""
