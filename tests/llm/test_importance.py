"""Importance resampling against a plain version, with string n-grams and one dictionary."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import importance
from tidemark.llm.queries import op13_importance_resample

DIR = "/root/testdata/sf0.001"


def words_of(text):
    low = (text or "").encode().translate(importance.ASCII_LOWER)
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def buckets_of(text):
    words = words_of(text)
    return [zlib.crc32(b" ".join(words[i : i + k])) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain(docs, target, percent=5, least=20, seed=42):
    """{row number: (n_features, weight, score, rank)} of ``(id, text)`` rows."""
    source = Counter(b for _, text in docs for b in buckets_of(text))
    wanted = Counter(b for text in target for b in buckets_of(text))
    all_s, all_t = sum(source.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (all_s + 10_000) / ((source[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    out, able = {}, []
    for row, (i, text) in enumerate(docs):
        buckets = buckets_of(text)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in buckets)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[row] = [len(buckets), weight, score, None]
        if len(words_of(text)) >= least:
            able.append((-score, math.inf if i is None else i, row))
    for rank, (_, _, row) in enumerate(sorted(able)[: percent * len(able) // 100], 1):
        out[row][3] = rank
    return out


def test_query_against_the_plain_version(spark):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{DIR}/benchmark.parquet").select("text").collect()]
    got = sorted(tuple(r) for r in op13_importance_resample(spark, DIR).collect())
    want = sorted((docs[row][0], *values) for row, values in plain(docs, target).items())
    assert got == want and any(r[4] for r in got)


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_draws_of_any_size(spark, parts, monkeypatch):
    monkeypatch.setattr(importance, "PARTS", parts)
    rows = [(i, " ".join(f"w{(i * k) % 37}" for k in range(i % 60))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    target = spark.createDataFrame([("w1 w2 w3 w4",), (None,)], "text string")
    for percent in (5, 60, 100):
        got = sorted(tuple(r) for r in importance.resample(docs, target, percent=percent).collect())
        want = plain(rows, ["w1 w2 w3 w4", None], percent)
        assert got == sorted((rows[k][0], *v) for k, v in want.items())


def test_odd_rows(spark):
    """Nulls, empty texts, repeated rows, clashing columns, one very long text and one very long word."""
    long = "lorem ipsum dolor " * 300_000
    rows = [(1, None), (2, ""), (3, " .,- "), (None, "a b c " * 10), (None, "a b c " * 10), (5, "Ünïcode 漢字 " * 30), (5, "Ünïcode 漢字 " * 30),
            (6, long), (7, "q" * 3_000_000), (8, "one")]
    extra = ["id", "stream", "score", "rank", "a.b", "part", "weight"]
    docs = spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in extra))
    target = spark.createDataFrame([("x", "lorem ipsum"), ("y", None)], "item_id string, text string")
    got = importance.resample(docs.repartition(4), target, percent=100).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want = [(rows[k][0], *v) for k, v in plain(rows, ["lorem ipsum", None], 100).items()]
    # Rows that are alike may swap ranks.
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    assert {r["doc_id"] for r in got if r["rank"]} == {None, 5, 6}


def test_nothing_in_the_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert importance.resample(docs, some).collect() == []
    (row,) = importance.resample(some, docs).collect()
    assert row["n_features"] == 6 and row["rank"] is None and math.isfinite(row["weight"])


def test_checksums_of_slices_and_long_words(monkeypatch):
    rng = np.random.default_rng(1)
    text = b" ".join(bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in (1, 63, 64, 65, 128, 1000, 5, 70_000, 2, 3))
    whole = importance.packed([text])[1]
    assert sorted(whole.tolist()) == sorted(buckets_of(text.decode()))
    for size in (1, 10, 100, 5000):
        monkeypatch.setattr(importance, "SLICE_BYTES", size)
        assert (importance.packed([text])[1] == whole).all()
