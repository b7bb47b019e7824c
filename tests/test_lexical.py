"""The stored lexical index: what its tasks hold, and its rows against those of one scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark.operators import lexical


def test_a_stored_index_is_made_by_tasks_of_bounded_input(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    counts = []
    for name, copies in (("one", 1), ("four", 4)):
        # Ids that repeat with texts of one length are counted together.
        rows = docs.crossJoin(spark.range(copies)).select((F.col("doc_id") + F.col("id") * 1_000_000).alias("doc_id"), "text")
        rows = rows.union(rows.where("doc_id % 7 = 0"))
        plain = rows.coalesce(1).write.option("compression", "none").option("parquet.enable.dictionary", "false")
        plain.parquet(f"{tmp_path}/{name}")
        rows = spark.read.parquet(f"{tmp_path}/{name}")
        lexical.write_index(rows, f"{tmp_path}/{name}-index", "doc_id", "text", 4, task_bytes=20_000)
        index = spark.read.parquet(f"{tmp_path}/{name}-index/postings").drop("part")
        want = lexical.postings(rows, "doc_id", "text").select(*index.columns)
        assert index.exceptAll(want).isEmpty() and want.exceptAll(index).isEmpty()
        files = index.select(F.input_file_name().alias("f"), "doc_id")
        tasks = files.groupBy(F.regexp_extract("f", r"part-(\d+)", 1).alias("task")).agg(F.countDistinct("doc_id").alias("n"))
        counts.append(tasks.agg(F.max("n"), F.count("*")).first())
        # All postings of a document are made by one task.
        assert tasks.agg(F.sum("n")).first()[0] == index.select("doc_id").distinct().count()
    (most, few), (most_of_four, many) = counts
    assert many >= 3 * few and most_of_four <= 2 * most
