"""The best rows by products of blocks against every pair."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import vectors
from tidemark.operators import blocks


@pytest.mark.parametrize("block_rows", [7, 2048])
def test_best_rows_equal_those_of_all_pairs_with_ties_copies_and_odd_vectors(spark, monkeypatch, block_rows):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(blocks, "BLOCK_QUERIES", 5)
    rng = np.random.default_rng(1)
    data = [(i, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(300)]
    data += [(300 + i, [1.0, 2.0, 2.0]) for i in range(40)]
    data += [(400, None), (401, [1.0, None, 2.0]), (402, [1.0, 2.0]), (403, [0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0])]
    rows = spark.createDataFrame(data, "id long, v array<float>").repartition(4).withColumn("bucket", F.coalesce(F.col("id") % 2, F.lit(0)).cast("int"))
    queries = rows.where("id % 20 = 0 or id = 401").select(F.col("id").alias("query"), F.col("v").cast("array<double>").alias("q"))
    queries = queries.withColumn("mask", F.when(F.col("query") % 40 == 0, F.array(F.lit(1), F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1))))
    for bucket, mask in ((None, None), ("bucket", "mask")):
        on = F.col("query") != F.col("id")
        on = on if mask is None else on & (F.get("mask", F.col("bucket")) == 1)
        pairs = queries.join(rows, on).select("query", "id", F.round(vectors.cosine(F.col("v"), F.col("q")), 6).alias("score"))
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
        want = pairs.withColumn("rank", rank).where("rank <= 6")
        got = blocks.best(rows, queries, 6, "id", "v", 3, bucket, mask)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_no_pair_is_a_row_of_the_plan(spark):
    rows = spark.range(1000).select("id", F.array(F.sin("id"), F.cos("id")).alias("v"))
    queries = rows.where("id % 10 = 0").select(F.col("id").alias("query"), F.col("v").alias("q"))
    plan = blocks.best(rows, queries, 3, "id", "v", 2)._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan and "MapInArrow" in plan
