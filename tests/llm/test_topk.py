"""The pivot-distance index against brute force, on clusters, large numbers and repeated rows."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tests.conftest import DATA
from tidemark.llm import topk

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k=5, every=50, scale=256):
    hold = lambda x: max(-(2**62), min(2**62, math.floor(min(max(x * scale, -1e300), 1e300))))
    whole = {(i, tuple(map(hold, v))) for i, v in rows}
    scores = {}
    for i, q in whole:
        if i % every:
            continue
        for j, v in whole:
            if j != i and len(v) == len(q):
                score = sum(a * b for a, b in zip(q, v))
                scores.setdefault(i, []).append((-max(-(2**63), min(2**63 - 1, score)), j))
    return sorted((i, r, j, -s) for i, x in scores.items() for r, (s, j) in enumerate(sorted(x)[:k], 1))


def found(df, **options):
    return sorted(map(tuple, topk.exact_top_k(df, **options).collect()))


@pytest.fixture(scope="module")
def clusters():
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(40, 16))
    points = middles[rng.integers(0, 40, 3000)] + rng.normal(scale=0.05, size=(3000, 16))
    return [(i, [float(x) for x in v]) for i, v in enumerate(points)]


@pytest.mark.parametrize("unit", [True, False])
def test_clusters_are_pruned(spark, clusters, unit):
    rows = [(i, [x / math.hypot(*v) for x in v]) if unit else (i, v) for i, v in clusters]
    work: dict = {}
    assert found(spark.createDataFrame(rows, SCHEMA), work=work) == brute(rows)
    assert work["all"] == 60 * 3000
    assert work["pairs"] < 0.5 * work["all"], work


def test_every_annulus_is_opened_where_nothing_tells_vectors_apart(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(600, 64)))]
    work: dict = {}
    assert found(spark.createDataFrame(rows, SCHEMA), work=work) == brute(rows)
    assert work["pairs"] <= work["all"]


@pytest.mark.parametrize("size", [1e10, 1e16, 1e250])
def test_large_components(spark, size):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(120, 3)) * size)]
    rows += [(500, [size, 1.0, 0.0]), (501, [-size, 1.0, 0.25]), (502, [1.0, 1.0, 1.0]), (550, [1e10, 1.0, 0.0])]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_products_in_limbs_are_exact():
    rng = np.random.default_rng(4)
    for bits in (20, 30, 40, 62):
        a, b = (rng.integers(-(2**bits), 2**bits, (7, 5)) for _ in range(2))
        want = [[max(-(2**63), min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(p, q)))) for q in b] for p in a]
        assert topk.products(a, b).tolist() == want


def test_repeated_rows_and_vectors(spark):
    rows = [(i, [1.0, 0.5]) for i in range(300)] * 20 + [(0, [0.5, 1.0]), (50, None), (50, [1.0, float("nan")])]
    df = spark.createDataFrame(rows, SCHEMA)
    good = [r for r in rows if r[1] and r[1][1] == r[1][1]]
    assert found(df) == brute(good)


def test_given_table(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [(r[0], list(r[1])) for r in df.select("vec_id", "embedding").collect()]
    assert found(df) == brute(rows)
