"""Readers and writers. Readers name their columns, so scans stay narrow and pushed down."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


#: Bytes of rows that a Python worker gets at a time at most; one longer row comes alone.
BATCH_BYTES = 1 << 20


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold BATCH_BYTES at most: workers hold a batch several times over, whatever the number of its rows.

    Batches are formed when a query runs, after this returns, so the session keeps the setting. It is only ever lowered.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < held <= BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A Parquet table of a folder; timestamps without zone are read as UTC. Python workers get it in small batches."""
    small_batches(spark)
    df = spark.read.parquet(f"{base}/{name}.parquet")
    naive = {f.name: F.col(f.name).cast("timestamp") for f in df.schema if f.dataType.typeName() == "timestamp_ntz"}
    return df.withColumns(naive) if naive else df


#: Bytes for each task below which a table is dealt out before work that costs far more than a shuffle of it.
SPREAD_BYTES = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all tasks if it is too small for its files to do so, else as it is.

    A file of one row group is read by one task, whatever its size. The plan's own statistics
    decide; a large table is never shuffled for this.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(tasks) if int(str(size)) < SPREAD_BYTES * tasks else df


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from JSON lines."""
    schema = "id string, scenario_class string, query string, expected_evidence_ids array<string>, expected_no_evidence boolean"
    return spark.read.schema(schema).json(path)


def timings(spark: SparkSession, path: str) -> DataFrame:
    """``(ms)``: the last field of every line of a tab, comma or blank separated file that is a number."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"))
    return (
        lines.where((F.col("line") != "") & ~F.col("line").startswith("#"))
        .select(F.expr("try_cast(element_at(split(line, '[\\\\t, ]+'), -1) AS double)").alias("ms"))
        .where("ms is not null")
    )


def perf_log(spark: SparkSession, path: str, component: str | None = None, limit: int = 200) -> DataFrame:
    """Latest entries of a JSON-lines log; lines that don't parse keep their raw text."""
    schema = "ts string, component string, event string, value double"
    parsed = spark.read.text(path).select("value", F.from_json("value", schema).alias("j"))
    rows = parsed.select(
        "j.ts", "j.component", "j.event", F.col("j.value").alias("value"),
        F.when(F.col("j.ts").isNull(), F.col("value")).alias("raw"),
    )
    if component is not None:
        rows = rows.where(F.col("component") == component)
    return rows.orderBy(F.col("ts").desc_nulls_last()).limit(limit)


def folder_size(spark: SparkSession, path: str) -> DataFrame:
    """``(bytes)`` of all files below a folder, from file metadata alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def export_jsonl(events: DataFrame, out: str, as_of, days: int, ts: str = "ts") -> DataFrame:
    """Events of the last ``days`` days as JSON lines in time order; returns a one-row manifest."""
    chosen = events.where(F.col(ts) >= F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days)))
    # Range partitions keep the order over files without one task holding everything.
    chosen.repartitionByRange(ts).sortWithinPartitions(ts).write.mode("overwrite").json(out)
    return chosen.agg(F.count("*").alias("events"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def append(df: DataFrame, path: str, *by: str) -> None:
    """Append rows to a Parquet table, partitioned by columns."""
    df.write.mode("append").partitionBy(*by).parquet(path)


def append_new(df: DataFrame, path: str, key: list[str], *by: str) -> None:
    """Append rows whose key the table lacks, each key once, so that writing a batch again changes nothing."""
    spark = df.sparkSession
    fresh = df.dropDuplicates(key)
    if _exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(*key), key, "left_anti")
    append(fresh, path, *by)


def append_log(df: DataFrame, path: str, most_bytes: int = 5_000_000, keep: int = 5) -> None:
    """Append JSON lines to the newest folder ``log=n`` of a log; a new one begins once that has ``most_bytes``.

    The oldest folders beyond ``keep`` go.
    """
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
    numbers = sorted(int(n[4:]) for n in names if n.startswith("log=") and n[4:].isdigit())
    last = numbers[-1] if numbers else 0
    if numbers and fs.getContentSummary(hadoop.Path(f"{path}/log={last}")).getLength() >= most_bytes:
        last += 1
        numbers.append(last)
    df.write.mode("append").json(f"{path}/log={last}")
    for old in numbers[:-keep]:
        fs.delete(hadoop.Path(f"{path}/log={old}"), True)


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one JSON file, in the place of the last one."""
    df.coalesce(1).write.mode("overwrite").json(path)


def append_report(df: DataFrame, path: str) -> None:
    """A report's rows beside those of earlier reports."""
    df.write.mode("append").json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


#: Columns of events that come in as JSON.
EVENT_SCHEMA = (
    "event_id string, ts_start timestamp, ts_end timestamp, app_name string, window_title string, url string, "
    "domain string, ocr_text string, monitor_id string, paused boolean, tags string"
)


def json_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of events from JSON lines in a folder; lines that don't parse have a null id."""
    return spark.readStream.schema(EVENT_SCHEMA).json(path)
