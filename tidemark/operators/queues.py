"""Job tables as pure functions: idempotent enqueueing with a backlog cap, leases, failures, stale leases.

Spark's own task retries and checkpoints replace worker queues; these functions give the
states that such a table is in after a step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def enqueue(jobs: DataFrame, new: DataFrame, key: str, order: str, most_pending: int | None = None) -> DataFrame:
    """jobs with those new ones whose key isn't there, as pending; no more than the backlog's room takes.

    New jobs come in order; of several of one key the first counts. A key that is
    there takes no room.
    """
    first = Window.partitionBy(key).orderBy(order)
    fresh = new.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    fresh = fresh.join(jobs.select(key), key, "left_anti")
    if most_pending is not None:
        pending = jobs.agg((F.lit(most_pending) - F.count_if(F.col("status") == "pending")).alias("_room"))
        # The room bounds what is ordered.
        head = fresh.orderBy(order, key).limit(most_pending)
        nth = F.row_number().over(Window.orderBy(order, key))
        fresh = head.withColumn("_n", nth).join(F.broadcast(pending)).where("_n <= _room").drop("_n", "_room")
    fresh = fresh.withColumn("status", F.lit("pending")).withColumn("attempts", F.lit(0))
    return jobs.unionByName(fresh, allowMissingColumns=True)


def lease_order(jobs: DataFrame, as_of: Column, kinds: Sequence[str] = ()) -> DataFrame:
    """Jobs that may be leased: pending, due, with attempts left, of some kinds."""
    ready = (F.col("status") == "pending") & (F.col("scheduled_for") <= as_of) & (F.col("attempts") < F.col("max_attempts"))
    if kinds:
        ready = ready & F.col("job_type").isin(*kinds)
    return jobs.where(ready)


def lease(jobs: DataFrame, as_of: Column, worker: str, seconds: float, n: int = 1, kinds: Sequence[str] = ()) -> DataFrame:
    """jobs after a worker took the first ``n`` that it may, by schedule, creation and key."""
    first = lease_order(jobs, as_of, kinds).orderBy("scheduled_for", "created_at", "job_key").limit(n)
    taken = F.broadcast(first.select("job_key", F.lit(True).alias("_taken")))  # n rows
    joined = jobs.join(taken, "job_key", "left")
    got = F.coalesce("_taken", F.lit(False))
    until = F.timestamp_micros(F.unix_micros(as_of) + F.lit(int(seconds * 1e6)))
    return (
        joined.withColumn("status", F.when(got, "leased").otherwise(F.col("status")))
        .withColumn("attempts", F.col("attempts") + got.cast("int"))
        .withColumn("leased_by", F.when(got, worker).otherwise(F.col("leased_by")))
        .withColumn("lease_expires_at", F.when(got, until).otherwise(F.col("lease_expires_at")))
        .drop("_taken")
    )


def fail(jobs: DataFrame, failures: DataFrame, as_of: Column, retry_seconds: float = 0) -> DataFrame:
    """jobs after some failed ``(job_key, error)``: pending again while attempts are left, else failed for good."""
    joined = jobs.join(failures.select("job_key", F.col("error").alias("_error")), "job_key", "left")
    bad, again = F.col("_error").isNotNull(), F.col("attempts") < F.col("max_attempts")
    later = F.timestamp_micros(F.unix_micros(as_of) + F.lit(int(retry_seconds * 1e6)))
    status = F.when(bad & again, "pending").when(bad, "failed").otherwise(F.col("status"))
    return (
        joined.withColumn("scheduled_for", F.when(bad & again, later).otherwise(F.col("scheduled_for")))
        .withColumn("status", status)
        .withColumn("last_error", F.coalesce("_error", "last_error"))
        .drop("_error")
    )


def recover_stale(jobs: DataFrame, as_of: Column) -> DataFrame:
    """jobs whose leases ran out as pending again, or failed where no attempt is left."""
    stale = (F.col("status") == "leased") & (F.col("lease_expires_at") < as_of)
    status = F.when(stale & (F.col("attempts") < F.col("max_attempts")), "pending").when(stale, "failed")
    return jobs.withColumn("leased_by", F.when(~F.coalesce(stale, F.lit(False)), F.col("leased_by"))).withColumn(
        "status", F.coalesce(status, F.col("status"))
    )
