"""Tables that are changed part by part, and changes that meet."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tidemark.sources import versions


@pytest.fixture
def path(spark, tmp_path):
    rows = spark.range(100).select("id", F.lit("old").alias("v"))
    versions.create(rows, str(tmp_path), "id", parts=8)
    return str(tmp_path)


def held(spark, path, version=None):
    return {r["id"]: r["v"] for r in versions.read(spark, path, version).collect()}


def test_changes_write_only_the_parts_that_they_touch(spark, path):
    before = versions.latest(spark, path)
    new = spark.createDataFrame([(3, "new"), (200, "new")], "id long, v string")
    after = versions.upsert(spark, path, new)
    touched = {r[0] for r in new.select(versions.part_of("id", 8)).collect()}
    assert {p for p in range(8) if before.files.get(p) != after.files.get(p)} == touched
    assert held(spark, path) == {**{i: "old" for i in range(100)}, 3: "new", 200: "new"}
    assert held(spark, path, before) == {i: "old" for i in range(100)}  # a reader keeps its version
    versions.insert_new(spark, path, spark.createDataFrame([(3, "again"), (300, "first")], "id long, v string"))
    assert held(spark, path)[3] == "new" and held(spark, path)[300] == "first"
    versions.delete_where(spark, path, F.col("id").between(10, 20))
    versions.delete_keys(spark, path, spark.createDataFrame([(3,), (999,)], "id long"))
    assert held(spark, path).keys() == {*range(10), *range(21, 100), 200, 300} - {3}
    number = versions.latest(spark, path).number
    assert versions.delete_where(spark, path, F.col("id") < 0).number == number  # nothing to do, no version
    assert versions.clean(spark, path, keep=1) > 0
    assert held(spark, path).keys() == {*range(10), *range(21, 100), 200, 300} - {3}


def test_of_two_changes_of_a_part_one_is_made_anew(spark, path):
    tries = []

    def made(old):
        tries.append(1)
        if len(tries) == 1:  # another change comes between reading and publishing
            versions.upsert(spark, path, spark.createDataFrame([(1, "theirs")], "id long, v string"))
        return old.withColumn("v", F.when(F.col("id") == 2, "ours").otherwise(F.col("v")))

    versions.change(spark, path, lambda v: list(range(8)), made)
    assert len(tries) == 2
    assert held(spark, path) == {**{i: "old" for i in range(100)}, 1: "theirs", 2: "ours"}


def test_changes_of_other_parts_go_on_top(spark, path):
    ids = {p: i for i, p in enumerate(r[0] for r in spark.range(100).select(versions.part_of("id", 8)).collect())}
    (p1, i1), (p2, i2), *_ = ids.items()
    tries = []

    def made(old):
        tries.append(1)
        versions.upsert(spark, path, spark.createDataFrame([(i2, "theirs")], "id long, v string"))
        return old.withColumn("v", F.when(F.col("id") == i1, "ours").otherwise(F.col("v")))

    versions.change(spark, path, lambda v: [p1], made)
    assert len(tries) == 1 and held(spark, path)[i1] == "ours" and held(spark, path)[i2] == "theirs"


def test_changes_at_the_same_time_lose_nothing(spark, path):
    def put(n):
        rows = spark.createDataFrame([(n, f"w{n}"), (1000 + n, f"w{n}")], "id long, v string")
        return versions.upsert(spark, path, rows)

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(put, range(3)))
    got = held(spark, path)
    assert all(got[n] == got[1000 + n] == f"w{n}" for n in range(3)) and len(got) == 103
    assert versions.latest(spark, path).number == 4


def test_a_change_that_is_always_overtaken_gives_up(spark, path, monkeypatch):
    monkeypatch.setattr(versions, "TRIES", 2)

    def made(old):
        versions.upsert(spark, path, spark.createDataFrame([(1, "theirs")], "id long, v string"))
        return old

    with pytest.raises(versions.Conflict):
        versions.change(spark, path, lambda v: list(range(8)), made)
