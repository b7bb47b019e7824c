"""Keyed state of streams that ends: decaying sums of touches, with timers that delete what nothing has touched for long.

The store behind it must be RocksDB (``spark.sql.streaming.stateStore.providerClass``); :func:`with_rocksdb` sets that.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.memory import HALF_LIVES, WEIGHTS

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "last double, kept double, " + ", ".join(f"{name} double" for name in HALF_LIVES)


def with_rocksdb(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    return spark


class DecayingTouches(StatefulProcessor):
    """Four decaying sums of a key's touches; one that is late or too soon after the last accepted one isn't added.

    Within a micro-batch touches are taken in time order. What a key's state holds is forgotten ``ttl`` seconds of event
    time after its last touch: the next one begins anew.
    """

    def __init__(self, seconds: float, ttl: float):
        self.seconds, self.ttl = seconds, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("touches", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, kept, *sums = self.held.get() if self.held.exists() else (None, None, *(0.0 for _ in HALF_LIVES))
        out = []
        for at in sorted(t.timestamp() for batch in rows for t in batch["ts"]):
            reason = None
            if last is not None and at >= last + self.ttl:
                last, kept, sums = None, None, [0.0 for _ in HALF_LIVES]
            if last is not None and at < last:
                reason = "out_of_order"
            elif kept is not None and at - kept < self.seconds:
                reason = "rate_limited"
            else:
                sums = [s * 2.0 ** -((at - (kept if kept is not None else at)) / half) + 1.0 for s, half in zip(sums, HALF_LIVES.values())]
                kept = at
            last = at if last is None else max(last, at)
            score = sum(w * s for w, s in zip(WEIGHTS.values(), sums))
            out.append((key[0], at, reason is None, reason, score))
        self.held.update((last, kept, *sums))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(int((last + self.ttl) * 1000), timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(out, columns=["key", "at", "accepted", "reason", "score"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield pd.DataFrame([], columns=["key", "at", "accepted", "reason", "score"])

    def close(self) -> None:
        pass


def decaying_touches(events: DataFrame, by: str, ts: str, seconds: float, ttl: float, late: str = "1 minute") -> DataFrame:
    """``(by, at, accepted, reason, score)`` of each touch, ``at`` in seconds since 1970 and the score as it then is."""
    with_rocksdb(events.sparkSession)
    kind = events.schema[by].dataType.simpleString()
    keyed = events.selectExpr(f"`{by}` as key", f"`{ts}` as ts").withWatermark("ts", late).groupBy("key")
    out = keyed.transformWithStateInPandas(
        DecayingTouches(seconds, ttl), f"key {kind}, at double, accepted boolean, reason string, score double", "append", "EventTime"
    )
    return out.withColumnRenamed("key", by)
