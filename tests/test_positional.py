"""The positional index against scans of all texts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark.functions import text
from tidemark.operators import lexical, positional


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    positional.write(docs, path, "doc_id", {"text": 1.0}, parts=8, block_docs=16)
    return path


QUERIES = [
    '"licensed under"', 'licensed NOT "licensed under"', "lic* OR moron", '("licensed under" OR idiot) NOT moron th*', "NOT the",
    "the AND (license OR NOT licensed)", '"the the"', "nosuchword", "un* NOT under",
]


@pytest.mark.parametrize("query", QUERIES)
def test_boolean_queries_match_what_a_scan_matches(spark, docs, folder, query):
    got = {r[0] for r in positional.search(spark, folder, query, "doc_id").collect()}
    with_terms = docs.where(F.size(text.terms(F.coalesce("text", F.lit("")))) > 0)
    assert got == {r[0] for r in lexical.boolean_search(with_terms, query, "doc_id", "text").collect()}


@pytest.mark.parametrize("k", [1, 7, 1000])
def test_best_k_equal_those_of_a_scan(spark, docs, folder, k):
    named = {"a": ["license", "the", "moron"], "b": ["licensed"], "c": ["nosuchword"], "d": ["the", "and", "of", "under"]}
    got = positional.top_k(spark, folder, positional.as_queries(spark, named), k, "doc_id").collect()
    for name, terms in named.items():
        scan = lexical.bm25(docs, terms, "doc_id", "text").withColumn("bm25", F.round("bm25", 6))
        want = [tuple(r) for r in scan.orderBy(F.desc("bm25"), "doc_id").limit(k).collect()]
        own = sorted((r for r in got if r["query"] == name), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(want) + 1))
        assert [r["doc_id"] for r in own] == [w[0] for w in want]
        assert [r["bm25"] for r in own] == pytest.approx([w[1] for w in want], abs=2e-6)


def test_blocks_are_spared_and_only_the_terms_folders_read(spark, docs, folder):
    rare = docs.select(F.explode(F.array_distinct(text.terms(F.col("text")))).alias("t")).groupBy("t").count()
    word = rare.where("count between 2 and 6 and length(t) > 5").orderBy("t").first()[0]
    wanted = positional.as_queries(spark, {"q": [word, "the"]})
    row = positional.read_share(spark, folder, wanted, 1).first()
    assert row["blocks_scored"] < row["blocks"] and row["postings_scored"] < row["postings"]
    rows = positional.folders(spark, folder, positional.as_queries(spark, {"q": [word]}), 8)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan
    assert rows.select(F.regexp_extract(F.input_file_name(), "part=([0-9]+)", 1)).distinct().count() == 1


def test_fields(spark, tmp_path):
    rows = [(1, "red fox", "the fox ran", None), (2, "blue", "a red fox", "fox fox"), (3, None, None, "fox"), (None, "fox", "fox", "fox"), (4, "", "", "")]
    docs = spark.createDataFrame(rows, "id long, title string, body string, tags string")
    path = str(tmp_path)
    positional.write(docs, path, "id", {"title": 2.0, "body": 1.0, "tags": 1.0}, parts=2, block_docs=2)
    ids = lambda q, f=None: sorted(r[0] for r in positional.search(spark, path, q, "id", f).collect())
    assert ids("fox") == [1, 2, 3]
    assert ids("fox", "title") == [1] and ids("fox", "tags") == [2, 3]
    assert ids('"fox the"') == []  # a phrase doesn't go from one field to the next
    assert ids('"red fox"', "body") == [2]
    best = positional.top_k(spark, path, positional.as_queries(spark, {"q": ["fox"]}), 3, "id").collect()
    tf = {1: 3.0, 2: 3.0, 3: 1.0}  # a title counts twice
    n = {1: 5, 2: 6, 3: 1}
    score = {i: 1e-6 * tf[i] * 2.2 / (tf[i] + 1.2 * (0.25 + 0.75 * n[i] / 4)) for i in tf}
    assert [r["id"] for r in sorted(best, key=lambda r: r["rank"])] == sorted(score, key=lambda i: (-round(score[i], 6), i))


def test_an_empty_table(spark, docs, tmp_path):
    positional.write(docs.limit(0), str(tmp_path), "doc_id", {"text": 1.0}, parts=2)
    assert positional.search(spark, str(tmp_path), "a NOT b", "doc_id").collect() == []
    assert positional.top_k(spark, str(tmp_path), positional.as_queries(spark, {"q": ["a"]}), 3, "doc_id").collect() == []


def test_words_are_no_rows_and_blocks_go_over_batches(spark, docs, tmp_path):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "3")
    try:
        dealt = docs.select(F.lit(0).alias("block"), F.col("doc_id").alias("key"), text.terms(F.coalesce("text", F.lit(""))).alias("t0"))
        rows = positional._postings(dealt.orderBy("key"), [1.0], 10.0, True)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "Aggregate" not in plan
        got = rows.select("term", F.inline(F.arrays_zip("keys", "lengths", "positions"))).collect()
    finally:
        spark.conf.set(name, before)
    want = {}
    for r in dealt.collect():
        for i, word in enumerate(r["t0"]):
            want.setdefault((word, r["key"], len(r["t0"])), []).append(i)
    assert sorted((*k, p) for k, p in want.items()) == sorted(map(tuple, got))
