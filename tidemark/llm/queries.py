"""The registered queries of this subpackage, and their oracle SQL where SQL can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mil_quality import quality

    documents, labels = (_table(spark, sf_dir, x) for x in ("documents", "labels"))
    return quality(documents, labels, threshold=0.5, held=(3, 1))


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_codec import encode

    out = encode(_table(spark, sf_dir, "documents"), vocabulary())
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "joins",
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), vocabulary(), limit=2048)


def op4_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import exact_top_k

    return exact_top_k(_table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"), threshold=0.8)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import fetch_days, filter_urls, listed_patterns

    pages = _table(spark, sf_dir, "pages")
    return filter_urls(fetch_days(pages), listed_patterns(pages))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    documents, labels = (_table(spark, sf_dir, x) for x in ("documents", "labels"))
    return toxicity(documents, labels, threshold=0.3, held=(4, 2))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents"), weights=(1, 2, 3), repeats=3)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import filter_audit

    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages"), least_bytes=1000)


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resample

    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=5, least_words=20, seed=42)


def queries() -> dict:
    return {
        name: f
        for name, f in sorted(globals().items(), key=lambda x: x[0])
        if name.startswith("op") and name[2].isdigit()
    }


#: Every component as floor(256 * x); a vector with none, or with one that isn't a finite number, is left out.
OP5_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    from . import filter_audit, license_scan, url_filter, warc

    return {
        "op5_exact_top_k": OP5_SQL,
        "op7_license_scan": license_scan.oracle(0.8),
        "op8_url_filter": url_filter.ORACLE,
        "op11_filter_audit": filter_audit.oracle(),
        "op12_warc": warc.ORACLE,
    }
