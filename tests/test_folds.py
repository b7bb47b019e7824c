"""Folds with keys cut into spans against the plain order of decisions."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import memory


def accepted(rows, limit):
    last, out = {}, set()
    for k, t, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        if k not in last or t - last[k] >= limit:
            last[k] = t
            out.add(i)
    return out


@pytest.mark.parametrize("span", [1, 7, 50, 5000])
def test_spans_decide_as_the_whole_key_does(spark, span):
    rng = random.Random(span)
    rows = [("hot" if rng.random() < 0.9 else rng.choice(["a", None]), rng.randrange(2000) / 2, i) for i in range(1500)]
    df = spark.createDataFrame([(k, dt.datetime.fromtimestamp(1_700_000_000 + t, dt.timezone.utc), i) for k, t, i in rows], "k string, ts timestamp, id long")
    for limit in (0.5, 10, 400):
        out = memory.rate_limited(df.repartition(4), ["k"], "ts", limit, "id", span_seconds=span)
        assert out.columns == ["k", "ts", "id", "accepted"] and out.count() == len(rows)
        assert {r["id"] for r in out.where("accepted").collect()} == accepted(rows, limit)


def test_a_hot_key_is_dealt_to_many_tasks(spark):
    df = spark.range(20_000).select(F.lit("k").alias("k"), F.timestamp_seconds(F.col("id")).alias("ts"), "id")
    out = memory.rate_limited(df, ["k"], "ts", 10, "id", span_seconds=500)
    assert out.where("accepted").count() == 2000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions would be put together
    try:
        assert out.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert memory.rate_limited(df.limit(0), ["k"], "ts", 10, "id", span_seconds=500).collect() == []
