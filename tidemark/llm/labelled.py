"""Bounded samples of labelled texts for training."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, fold

#: Bytes of all texts of a sample together: what the driver gets at most.
BUDGET_BYTES = 24_000_000


class Sample(NamedTuple):
    """Labelled texts, and how many rows of the drawn ids didn't fit the budget."""

    texts: list[str]
    labels: np.ndarray
    left_out: int


def within(sizes: Sequence[int], labels: Sequence[int], budget: int) -> list[int]:
    """Places of the rows that fit the budget, in order: half of it for each class first, then what is left for all."""
    left = {0: budget // 2, 1: budget - budget // 2}
    chosen = []
    for i, (n, c) in enumerate(zip(sizes, labels)):
        if n <= left[int(c == 1)]:
            left[int(c == 1)] -= n
            chosen.append(i)
    rest, taken = sum(left.values()), set(chosen)
    for i, n in enumerate(sizes):
        if i not in taken and n <= rest:
            rest -= n
            chosen.append(i)
    return sorted(chosen)


def least_hashed(rows: DataFrame, key: str, n: int, *columns: str) -> list:
    """The n rows of least hash of the key (ties by the other columns), to the driver.

    Where there are many more, only hashes below a bound that should leave somewhat more
    than n are ordered, so that tasks don't send n rows each. If it leaves fewer
    (a key that repeats very often has one hash), all rows are ordered after all.
    """
    hashed = rows.select(key, *columns, F.xxhash64(key).alias("_h"))
    count = rows.count()
    share = (n + 10 * n**0.5 + 100) / max(1, count)
    if share < 0.5:
        some = hashed.where(F.col("_h") < -(1 << 63) + int(share * (1 << 64)))
        got = some.orderBy("_h", key, *columns).limit(n).drop("_h").collect()
        if len(got) == n:
            return got
    return hashed.orderBy("_h", key, *columns).limit(n).drop("_h").collect()


def labelled_texts(
    docs: DataFrame, labels: DataFrame, label: str, held: tuple[int, int], sample: int, key: str, text: str,
    budget: int = BUDGET_BYTES,
) -> Sample:
    """At most ``sample`` labelled whole texts outside the held-out fold, by least id hash, of ``budget`` bytes together.

    Half of the room goes to each class; what one class leaves the other may use. Long texts are
    drawn like others; one that is longer than what is left of the budget is left out and counted. Where
    ids repeat in docs, still no more than ``sample`` rows are taken, equal ones once.
    """
    modulus, out = held
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (fold(key, modulus) != out))
    known = known.select(key, F.col(label).cast("int").alias("_label"))
    ones = least_hashed(known.where("_label = 1"), key, sample // 2, "_label")
    chosen = ones + least_hashed(known.where("_label = 0"), key, sample - len(ones), "_label")
    if not chosen:
        return Sample([], np.empty(0), 0)
    # Bounded by the sample size.
    picked = docs.sparkSession.createDataFrame(chosen, known.select(key, "_label").schema)
    texts = docs.select(column(key), F.coalesce(column(text), F.lit("")).alias("_text")).withColumn("_h", F.xxhash64("_text"))
    sizes = texts.join(F.broadcast(picked), key).select(key, "_label", "_h", F.octet_length("_text").alias("_n")).distinct()
    rows = sizes.orderBy(F.xxhash64(key), key, "_label", "_h").limit(sample).collect()
    fit = within([r["_n"] for r in rows], [r["_label"] for r in rows], budget)
    left_out = len(rows) - len(fit)
    if left_out:
        logging.getLogger(__name__).warning("%d of %d labelled rows are beyond the budget of %d bytes", left_out, len(rows), budget)
    if not fit:
        return Sample([], np.empty(0), left_out)
    wanted = docs.sparkSession.createDataFrame([rows[i][:3] for i in fit], sizes.drop("_n").schema)
    found = texts.join(F.broadcast(wanted), [key, "_h"]).groupBy(key, "_label", "_h").agg(F.first("_text").alias("_text"))
    got = sorted(found.select(key, "_text", "_label").collect(), key=lambda r: (r[0], r[1], r[2]))
    return Sample([r[1] for r in got], np.array([r[2] for r in got], float), left_out)
