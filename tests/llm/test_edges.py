"""Null, empty, repeated and clashing input for every operator."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tidemark.llm import (
    bpe_codec, license_scan, mil_quality, mixing, neardup, quality_rules, token_counts, topk, toxicity, url_filter,
)
from tidemark.llm.queries import vocabulary

# Column names of the operators' own that the input also has.
EXTRA = ["a.b", "_mix_words", "mix_words", "words", "copies", "text2", "h", "hits", "pairs", "row",
         "score", "size", "target", "taken", "id", "n", "key", "ids", "root", "src", "kept", "held_out", "predicted"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)

TEXTS = [
    (1, "one two three four five six seven"),
    (2, "one two three four five six seven"),
    (2, "one two three four five six seven"),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, "short"),
    (None, "one two three four five six seven"),
    (None, None),
    (7, "x" * 40_000),
    (8, "word " * 30_000),
    (9, "é漢字🙂 <|endoftext|> İΣς\x1c end"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (i, t, None if i == 3 else "en", None if i in (3, 4) else f"s{(i or 0) % 2}", None, *["x"] * len(EXTRA))
        for i, t in TEXTS
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (6, 1, 0), (8, 0, 0), (1, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").repartition(2)


def ids(rows):
    return sorted((r["doc_id"] for r in rows), key=lambda x: (x is None, x or 0))


EXPECTED_IDS = sorted((i for i, _ in TEXTS), key=lambda x: (x is None, x or 0))


def operators(labels):
    return {
        "quality": lambda d: mil_quality.quality(d, labels),
        "encode": lambda d: bpe_codec.encode(d, vocabulary()),
        "counts": lambda d: token_counts.token_counts(d, vocabulary()),
        "neardup": neardup.near_duplicates,
        "rules": lambda d: quality_rules.quality_rules(d, labels),
        "licenses": license_scan.scan_licenses,
        "toxicity": lambda d: toxicity.toxicity(d, labels),
        "mix": mixing.mix,
    }


@pytest.mark.parametrize("name", ["quality", "encode", "counts", "neardup", "rules", "licenses", "toxicity", "mix"])
def test_every_row_has_a_result_and_no_rows_give_none(name, docs, none, labels):
    run = operators(labels)[name]
    assert ids(run(docs).collect()) == EXPECTED_IDS
    out = run(none)
    assert out.collect() == [] and out.schema == run(docs).schema


@pytest.mark.parametrize("name", ["quality", "encode", "counts", "neardup", "rules", "licenses", "toxicity", "mix"])
def test_texts_of_millions_of_characters(spark, name, labels):
    """Longer than any slice, with and without blanks."""
    texts = ["x" * 3_000_000, "one two three four " * 200_000, "\n" * 2_500_000, "short text"]
    rows = spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    assert ids(operators(labels)[name](rows).collect()) == [0, 1, 2, 3]


@pytest.mark.parametrize("name", ["quality", "toxicity", "rules"])
def test_learning_without_labels(name, docs, labels):
    rows = operators(labels.limit(0))[name](docs).collect()
    assert ids(rows) == EXPECTED_IDS
    if name == "quality":
        assert all(r["score"] == pytest.approx(0.5) for r in rows)
    if name == "toxicity":
        assert all(r["predicted"] == 0 for r in rows)
    if name == "rules":
        assert all(r["kept"] == (not r["base_failed"]) for r in rows)


def test_encoding_of_odd_texts(docs):
    rows = {(r["doc_id"], tuple(r["ids"])): r for r in bpe_codec.encode(docs, vocabulary()).collect()}
    assert (3, ()) in rows and (4, ()) in rows and (5, ()) in rows
    assert any(49407 in k[1] for k in rows if k[0] == 9)


def test_components_of_odd_texts(docs):
    rows = neardup.near_duplicates(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert [r["component_id"] for r in by[2]] == [1, 1] and not any(r["kept"] for r in by[2])
    assert by[1][0]["kept"] and by[1][0]["n_shingles"] == 3
    for i in (3, 4, 5):
        assert by[i][0]["n_shingles"] == 0 and by[i][0]["component_id"] == i and by[i][0]["kept"]
    assert by[6][0]["n_shingles"] == 1 and by[8][0]["n_shingles"] == 1
    assert all(r["component_id"] is None and r["kept"] for r in by[None])


def test_mix_of_odd_texts(docs):
    rows = mixing.mix(docs).collect()
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert sum(r["taken"] for r in rows) == pytest.approx(sum(r["size"] for r in rows), rel=0.01)
    again = mixing.mix(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_stages_keep_columns_and_one_of_a_group(docs, none, labels):
    out = neardup.without_near_duplicates(docs)
    assert out.columns == docs.columns
    assert ids(out.collect()) == [1, 3, 4, 5, 6, 7, 8, 9, None, None]
    for stage in (mil_quality.good_documents, quality_rules.accepted_documents):
        got = stage(docs, labels)
        assert got.columns == docs.columns and got.count() <= docs.count()
        assert stage(none, labels).collect() == []
    again = docs.where("doc_id = 1").union(docs.where("doc_id = 1"))
    assert neardup.without_near_duplicates(again).count() == 1


def test_documents_of_a_mix_keep_their_columns(docs):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.where("text is null").collect()} == {3, None}
    assert {r["_mix_words"] for r in out.collect()} == {"x"} == {r["a.b"] for r in out.collect()}


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5]), (50, [1.0, 0.5]), (1, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [-1.0, 0.0]), (3, None), (4, [None, 1.0]),
        (5, [nan, 1.0]), (6, [inf, 1.0]), (7, []), (8, [3.0]), (100, [2.0]), (None, [1.0, 1.0]), (150, [0.0, 0.0]),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, score string, rank int")
    got = sorted(map(tuple, topk.exact_top_k(df, k=5).collect()))
    want = []
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            good[i] = [math.floor(256 * x) for x in v]
    for q in (i for i in good if i % 50 == 0):
        found = [
            (-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q and len(v) == len(good[q])
        ]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(sorted(found)[:5])]
    assert got == sorted(want)
    assert topk.exact_top_k(df.limit(0)).collect() == []


def test_very_common_sites_are_dealt_out(spark, monkeypatch):
    """With few and with many parts the result is the same."""
    rows = [(i, "http://hot.example.org/shop/x" if i % 3 else f"http://h{i}.org/") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    captures, listed = url_filter.fetch_days(pages), url_filter.listed_patterns(pages)
    got = []
    for shares in (1, 4, 1000):
        monkeypatch.setattr(url_filter, "SHARES", shares)
        got.append(sorted(map(str, url_filter.filter_urls(captures, listed).collect())))
    assert got[0] == got[1] == got[2] and len(got[0]) == 300


def test_hosts(spark):
    urls = {
        "http://[2001:DB8::1]:80/a": ("[2001:db8::1]", ["[2001:db8::1]"]),
        "http://user:p@ss@host.com/x": ("host.com", ["host.com"]),
        "http://example.org./x": ("example.org", ["example.org"]),
        "http://a.example.org:8080?q=@b": ("a.example.org", ["a.example.org", "example.org"]),
        "http://10.0.0.1/": ("10.0.0.1", ["10.0.0.1"]),
        "http://u@[::ffff:1.2.3.4]/": ("[::ffff:1.2.3.4]", ["[::ffff:1.2.3.4]"]),
        "http:///path": (None, None),
        "http://..": (None, None),
        "http://h.org/" + "long/" * 400_000: ("h.org", ["h.org"]),
    }
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    host = url_filter.host_of(df.url)
    got = df.select("url", host.alias("host"), url_filter.patterns_of(host, F.lit("")).alias("p")).collect()
    assert {r["url"]: (r["host"], r["p"] if r["host"] else None) for r in got} == urls


def test_urls(spark):
    schema = "page_id long, url string, day date, pattern string, rules string"
    import datetime as dt

    day = dt.date(2024, 5, 1)
    rows = [
        (1, "https://a.b.example.org/shop/1", day, "x", "y"),
        (2, None, day, "x", "y"),
        (3, "no url", day, "x", "y"),
        (4, "http://example.org", None, "x", "y"),
        (5, "HTTP://B.Example.ORG:80/x?y#z", day, "x", "y"),
        (None, "https://example.org/", day, "x", "y"),
    ]
    entries = [
        ("example.org", dt.date(2024, 1, 1), "add"), ("example.org", dt.date(2024, 5, 1), "remove"),
        ("b.example.org", dt.date(2024, 4, 1), "add"), ("b.example.org", dt.date(2024, 4, 1), "add"),
        ("example.org/shop", dt.date(2024, 5, 1), "add"), (None, day, "add"), ("x", None, "add"),
    ]
    captures = spark.createDataFrame(rows, schema)
    listed = spark.createDataFrame(entries, "pattern string, day date, action string")
    got = {r["page_id"]: (r["host"], r["blocked"], r["pattern"]) for r in url_filter.filter_urls(captures, listed).collect()}
    assert got == {
        1: ("a.b.example.org", True, "example.org/shop"),
        2: (None, False, None),
        3: (None, False, None),
        4: ("example.org", False, None),
        5: ("b.example.org", True, "b.example.org"),
        None: ("example.org", False, None),
    }
    assert not any(r["blocked"] for r in url_filter.filter_urls(captures, listed.limit(0)).collect())
    assert url_filter.filter_urls(captures.limit(0), listed).collect() == []
