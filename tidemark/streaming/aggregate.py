"""Structured Streaming forms of the stateful operators.

The reference order of events is arrival order; a stream here has a watermark,
which callers choose (a gap and a minute serve well). Each form has a batch form
in :mod:`tidemark.operators.sessions`, and tests hold the two against each other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators import policy


def tumbling_counts(events: DataFrame, ts: str, kind: str, width: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """``(bucket, kind, n)`` of aligned buckets; rows later than the watermark are dropped."""
    own = events.withWatermark(ts, late).groupBy(F.window(ts, width), kind)
    return own.agg(F.count("*").alias("n")).select(F.col("window.start").alias("bucket"), kind, "n")


def windowed_sessions(events: DataFrame, by: str, ts: str, gap: str, late: str = "1 minute") -> DataFrame:
    """``(by, ts_start, ts_end, n)`` of built-in session windows (an event exactly a gap later still belongs)."""
    own = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), by)
    counted = own.agg(F.count("*").alias("n"), F.max(ts).alias("ts_end"))
    return counted.select(by, F.col("session_window.start").alias("ts_start"), "ts_end", "n")


def idle_sessions(events: DataFrame, by: str, ts: str, kind: str, idle_seconds: float, late: str = "1 minute") -> DataFrame:
    """``(by, ts_start, ts_end, n, clicks)`` of sessions that close once idle for ``idle_seconds`` or more.

    State is one open session per key. Rows of a batch are folded in time order;
    a session closes when a later row or the watermark passes its end and the idle
    time. A run over what is there (available now) ends with the watermark at the newest
    rows, so each key's last session stays open in the state; the next run goes on with it.
    """
    kind_of = events.schema[by].dataType.simpleString()
    out = f"`{by}` {kind_of}, ts_start timestamp, ts_end timestamp, n long, clicks long"
    state = "first double, last double, n long, clicks long"

    def fold(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        done = []
        first, last, n, clicks = held.get if held.exists else (None, None, 0, 0)

        def close() -> None:
            ends = (pd.Timestamp(x, unit="s") for x in (round(first, 6), round(last, 6)))
            done.append((key[0], *ends, n, clicks))

        if held.hasTimedOut:
            close()
            held.remove()
        else:
            rows = pd.concat([b for b in batches]).sort_values(ts, kind="stable")
            for t, what in zip(rows[ts], rows[kind]):
                at = t.timestamp()
                if n and at - last >= idle_seconds:
                    close()
                    first, n, clicks = None, 0, 0
                first = at if first is None else first
                last, n, clicks = max(at, last or at), n + 1, clicks + int(what == "click")
            held.update((first, last, n, clicks))
            limit = int((last + idle_seconds) * 1000)
            held.setTimeoutTimestamp(max(limit, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(done, columns=[by, "ts_start", "ts_end", "n", "clicks"])

    keyed = events.select(by, ts, kind).withWatermark(ts, late).groupBy(by)
    return keyed.applyInPandasWithState(fold, out, state, "append", GroupStateTimeout.EventTimeTimeout)


def accepted_touches(events: DataFrame, by: str, ts: str, seconds: float, late: str = "1 minute") -> DataFrame:
    """``(by, ts, accepted, reason)``: touches within the rate limit and in order.

    A touch before its key's last one is out of order; one within ``seconds`` of
    the last accepted one is rate limited. Within a micro-batch a key's touches are taken
    in time order, so a rerun of a batch decides alike; out of order are those that an
    earlier batch has overtaken.
    """
    kind_of = events.schema[by].dataType.simpleString()
    out = f"`{by}` {kind_of}, ts timestamp, accepted boolean, reason string"

    def fold(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        last, kept = held.get if held.exists else (None, None)
        rows = []
        for t in sorted(t for batch in batches for t in batch[ts]):
            at, reason = t.timestamp(), None
            if last is not None and at < last:
                reason = "out_of_order"
            elif kept is not None and at - kept < seconds:
                reason = "rate_limited"
            else:
                kept = at
            last = at if last is None else max(last, at)
            rows.append((key[0], t, reason is None, reason))
        held.update((last, kept))
        yield pd.DataFrame(rows, columns=[by, "ts", "accepted", "reason"])

    keyed = events.select(by, ts).groupBy(by)
    return keyed.applyInPandasWithState(fold, out, "last double, kept double", "append", GroupStateTimeout.NoTimeout)


def exact_duplicates(events: DataFrame, key: list[str], ts: str, within: str) -> DataFrame:
    """events without rows whose key was seen within a time before."""
    return events.withWatermark(ts, within).dropDuplicatesWithinWatermark(key)


def run_available(stream: DataFrame, sink, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; ``sink(batch, batch_id)`` must be idempotent by batch id."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(sink)
        .start()
    )
    query.awaitTermination()


def ingested(
    events: DataFrame, monitors: Sequence[str] = (), processes: Sequence[str] = (), titles: Sequence[str] = ()
) -> DataFrame:
    """Incoming events with ``skipped``: why one becomes a skipped capture (its texts are dropped then), or null."""
    why = policy.capture_skipped(
        F.coalesce("paused", F.lit(False)), F.col("monitor_id"), F.col("app_name"), F.col("window_title"),
        monitors, processes, titles,
    )
    rows = events.where("event_id is not null").withColumn("skipped", why)
    for name in ("ocr_text", "window_title", "url"):
        rows = rows.withColumn(name, F.when(F.col("skipped").isNull(), F.col(name)))
    return rows


def bounded_batch(batch: DataFrame, most: int, *order: str) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) rows of a micro-batch: a queue with room for ``most`` rows keeps the first and counts the others.

    ``dropped`` has one row, ``(dropped)``.
    """
    kept = batch.orderBy(*order).limit(most)
    return kept, batch.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("dropped"))


def flush_by_size(stream: DataFrame, sink, checkpoint: str, seconds: float | None = None) -> StreamingQuery:
    """A query that writes micro-batches as they come, or every so many seconds; the source's options bound their size."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink)
    if seconds is not None:
        writer = writer.trigger(processingTime=f"{seconds} seconds")
    return writer.start()


def backfill(rows: DataFrame, key: str, size: int, sink, mark: str, most: int | None = None) -> int:
    """Go through a table by key in slices of ``size`` rows, and remember the last key done in the file ``mark``.

    ``sink(slice, first, last)`` must be idempotent by its keys; a run that ended goes on
    after the last slice that was marked. Returns the number of slices done, ``most`` at most.
    """
    spark = rows.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(mark)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    after = spark.read.text(mark).first()[0] if fs.exists(place) else None
    kind, done = rows.schema[key].dataType, 0
    while most is None or done < most:
        left = rows if after is None else rows.where(F.col(key) > F.lit(after).cast(kind))
        # The slice's last key is found by a bounded top-k; the slice itself is a range scan.
        ends = left.orderBy(key).limit(size).agg(F.min(key).cast("string"), F.max(key).cast("string")).first()
        if ends[1] is None:
            break
        sink(left.where(F.col(key) <= F.lit(ends[1]).cast(kind)), ends[0], ends[1])
        after = ends[1]
        out = fs.create(place, True)
        out.write(bytearray(after.encode()))
        out.close()
        done += 1
    return done
