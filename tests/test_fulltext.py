"""Stems by the published examples, cover density by trying every stretch of a text."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark.operators import fulltext

STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre",
    "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl",
    "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail",
    "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration",
    "valenci": "valenc", "digitizer": "digit", "conformabli": "conform", "radicalli": "radic", "differentli": "differ", "vileli": "vile",
    "analogousli": "analog", "vietnamization": "vietnam", "predication": "predic", "operator": "oper", "feudalism": "feudal",
    "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous", "formaliti": "formal", "sensitiviti": "sensit",
    "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "formalize": "formal", "electriciti": "electr",
    "electrical": "electr", "hopeful": "hope", "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer",
    "airliner": "airlin", "gyroscopic": "gyroscop", "adjustable": "adjust", "defensible": "defens", "irritant": "irrit",
    "replacement": "replac", "adjustment": "adjust", "dependent": "depend", "adoption": "adopt", "communism": "commun",
    "activate": "activ", "homologous": "homolog", "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate",
    "cease": "ceas", "controll": "control", "roll": "roll", "generalizations": "gener", "oscillators": "oscil", "is": "is", "a": "a", "": "",
}


def test_published_examples(spark):
    df = spark.createDataFrame([(w,) for w in STEMS], "w string")
    assert {r[0]: r[1] for r in df.select("w", fulltext.stem(F.col("w"))).collect()} == STEMS


def plain(words, stems, stem_of):
    """Score and number of the stretches that hold all stems and have no shorter one inside."""
    at = [(i, stem_of[w]) for i, w in enumerate(words) if stem_of[w] in stems]
    covers = []
    for a in range(len(at)):
        for b in range(a, len(at)):
            if {s for _, s in at[a : b + 1]} == stems:
                if {s for _, s in at[a + 1 : b + 1]} != stems and {s for _, s in at[a:b]} != stems:
                    covers.append((at[b][0] - at[a][0]) - (b - a))
                break
    return sum(0.1 / (1 + n) for n in covers), len(covers)


@pytest.mark.parametrize("query", [["hop"], ["hopping", "cats"], ["agreed", "cat", "hopeful"], ["missing", "cat"]])
def test_covers(spark, query):
    rng = random.Random(1)
    vocabulary = ["hop", "hops", "hopping", "cat", "cats", "agree", "agreed", "hopeful", "the", "of", "x"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(40)))) for i in range(80)] + [(98, None), (99, "")]
    docs = spark.createDataFrame(rows, "id long, body string")
    words = spark.createDataFrame([(w,) for w in {*vocabulary, *query}], "w string")
    stem_of = {r[0]: r[1] for r in words.select("w", fulltext.stem(F.col("w"))).collect()}
    want = {i: plain((b or "").split(), {stem_of[w] for w in query}, stem_of) for i, b in rows}
    got = {r["id"]: (r["rank"], r["covers"]) for r in fulltext.cover_density(docs, query, "id", "body").collect()}
    assert got.keys() == {i for i, (_, n) in want.items() if n}
    for i, (rank, n) in got.items():
        assert n == want[i][1] and rank == pytest.approx(want[i][0])


def test_query_against_the_plain_version(spark):
    from tidemark.plans import catalogue

    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    words = {r["doc_id"]: re.findall("[a-z0-9_]+", (r["text"] or "").lower()) for r in rows}
    every = spark.createDataFrame([(w,) for w in {w for ws in words.values() for w in ws}], "w string")
    stem_of = {r[0]: r[1] for r in every.select("w", fulltext.stem(F.col("w"))).collect()}
    want = {i: plain(ws, {"licens", "under"}, stem_of) for i, ws in words.items()}
    got = {r["doc_id"]: (r["rank"], r["covers"]) for r in catalogue.queries()["fts_cover_density"](spark, DATA).collect()}
    assert got == {i: (round(x, 6), n) for i, (x, n) in want.items() if n} and got
