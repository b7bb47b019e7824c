"""How much Python workers get at a time."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.sources import tables


def test_python_workers_get_batches_of_few_bytes(spark, tmp_path):
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
    try:
        spark.range(0, 2000, 1, 1).select("id", F.repeat(F.lit("é"), 10_000).alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
        docs = tables.table(spark, str(tmp_path), "documents")

        @F.pandas_udf("long")
        def rows_in_batch(x):
            return x.map(lambda _: len(x))

        most = docs.select(rows_in_batch(text.nfkc("text")).alias("n")).agg(F.max("n")).first()[0]
        assert most * 20_000 <= 2 * tables.BATCH_BYTES
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)
