"""The pipeline stage by stage, and on nothing."""

from __future__ import annotations

import numpy as np

import corpus_pipeline as pipeline

DIR = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = docs
        stage(spark, docs, DIR).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids = {r[0] for r in docs.select("doc_id").collect()}
        was = {r[0] for r in before.select("doc_id").collect()}
        assert ids <= was
        if k < 4:
            assert docs.columns == columns
        if name in ("quality_classifier", "quality_rules"):
            good = [i for i in was if i in labels and labels[i]["quality"] == 1]
            assert np.mean([i in ids for i in good]) > 0.97
            assert docs.count() == len(ids)
        if name == "near_duplicates":
            from tidemark.llm.neardup import near_duplicates

            assert docs.count() == len(ids) < len(was)
            assert all(r["kept"] for r in near_duplicates(docs, 80).collect())
    assert docs.count() == before.count() and "decoded" in docs.columns


def test_no_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for name, stage in pipeline.STAGES:
        stage(spark, docs, DIR).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0


def test_rules_are_learned_on_the_documents_table(spark):
    from tidemark.llm.queries import op6_quality_rules

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    bad = spark.read.parquet(f"{DIR}/labels.parquet").where("quality = 0").select("doc_id")
    fed = docs.join(bad, "doc_id", "left_anti")  # as after a classifier that has caught all labelled bad ones
    verdicts = op6_quality_rules(spark, DIR).where("not base_failed").join(fed.select("doc_id"), "doc_id")
    rejected = {r[0] for r in verdicts.where("not kept").select("doc_id").collect()}
    kept = {r[0] for r in verdicts.where("kept").select("doc_id").collect()}
    out = {r[0] for r in pipeline.quality_rules(spark, fed, DIR).select("doc_id").collect()}
    assert rejected and not rejected & out
    assert kept and kept <= out


def test_run_on_odd_rows(spark, tmp_path, monkeypatch):
    """Nulls in every column, repeated rows, clashing names and dots go through; only the last table stays."""
    odd = spark.read.parquet(f"{DIR}/documents.parquet").where("doc_id < 60")
    nulls = odd.limit(1).selectExpr(*(f"cast(null as {t}) as {c}" for c, t in odd.dtypes))
    rows = odd.union(odd.limit(3)).union(nulls)
    extra = ["a.b", "key", "row", "mix_words", "kept", "score", "ids", "id", "n"]
    rows = rows.toDF(*odd.columns).selectExpr("*", *(f"'x' as `{c}`" for c in extra))
    base = str(tmp_path / "in")
    rows.write.parquet(f"{base}/documents.parquet")
    spark.read.parquet(f"{DIR}/labels.parquet").write.parquet(f"{base}/labels.parquet")
    monkeypatch.setattr(pipeline, "shared_folder", lambda spark: str(tmp_path / "shared"))
    out = pipeline.run(spark, base)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    ids = {r[0] for r in out.select("doc_id").collect()}
    assert ids and ids <= {r[0] for r in rows.select("doc_id").collect()}
    left = [p.name for p in (tmp_path / "shared").glob("*/*")]
    assert left == ["4_bpe_encoding"]


def test_every_stage_keeps_odd_columns(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("doc_id < 40").selectExpr("*", "'x' as `a.b`", "'y' as words")
    for name, stage in pipeline.STAGES[:4]:
        got = stage(spark, docs, DIR)
        assert got.columns == docs.columns, name
        assert {tuple(r) for r in got.select("`a.b`", "words").collect()} <= {("x", "y")}
