"""A training-data pipeline: five stages over the documents table.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All stages but the
last return the columns of documents.

1. ``quality_classifier`` drops documents that the attention classifier scores
   below 0.5.
2. ``quality_rules`` drops documents that the learned decision list rejects. The
   list is learned on the documents table, not on what stage 1 has left of it.
   The fixed base rule of the rules operator (50 words, repeated windows) is
   not part of this stage: clean documents may be short.
3. ``near_duplicates`` keeps one document of each group (five-word shingles,
   similarity 0.8).
4. ``source_mixing`` repeats or drops documents so that sources come near their
   target weights.
5. ``bpe_encoding`` encodes whole texts and decodes the ids again.

Edge cases follow the operators: null texts count as empty; an empty table gives
an empty table at every stage; extra columns of documents, whatever their names, are
carried along by all stages but the last, which gives its own columns only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe_codec import encode
from tidemark.llm.common import all_stages_end, remove, shared_folder
from tidemark.llm.mil_quality import good_documents
from tidemark.llm.mixing import mixed_documents
from tidemark.llm.neardup import without_near_duplicates
from tidemark.llm.quality_rules import accepted_documents
from tidemark.llm.queries import vocabulary


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return good_documents(docs, _labels(spark, sf_dir), threshold=0.5)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    every = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return accepted_documents(docs, _labels(spark, sf_dir), learn_on=every)


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_duplicates(docs, percent=80)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode(docs, vocabulary()).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded"
    )


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicate_removal),
    ("source_mixing", source_mixing),
    ("bpe_encoding", bpe_encoding),
]

#: Learned weights and hash orders decide which rows are left, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again.

    The tables between stages go to the shared folder that the cluster names in
    ``spark.checkpoint.dir``; a temporary folder serves where it is unset, on one machine only.
    """
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        with all_stages_end(spark):
            result.write.parquet(out := f"{base}/{k}_{name}")
        docs = spark.read.parquet(out)
        if before:
            remove(spark, before)
        before = out
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
