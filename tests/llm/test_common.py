"""Helpers that operators share."""

from __future__ import annotations

import time

from tidemark.llm.common import discard, materialise

RULES = "spark.sql.adaptive.optimizer.excludedRules"


def test_nothing_reads_a_frame_after_its_query(spark, tmp_path):
    """A join with an empty side ends after the tasks of its other side, so the frame that they read can go."""

    def slow(batches):
        for batch in batches:
            time.sleep(1)
            yield batch
        (tmp_path / f"{time.time_ns()}").touch()

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, none = materialise(spark.range(0, 800, 1, 4)), materialise(spark.range(10).where("id > 100"))
        out = materialise(rows.mapInArrow(slow, "id long").join(none, "id"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert len(list(tmp_path.iterdir())) == 4
    discard(rows, none)
    assert out.isEmpty()


def test_settings_stay(spark):
    assert spark.conf.get(RULES, None) is None
    try:
        spark.conf.set(RULES, "some.Rule")
        materialise(spark.range(1))
        assert spark.conf.get(RULES) == "some.Rule"
    finally:
        spark.conf.unset(RULES)
    materialise(spark.range(1))
    assert spark.conf.get(RULES, None) is None
