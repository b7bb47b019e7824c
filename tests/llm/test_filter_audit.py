"""The filter audit against a plain version that applies the filters one after another."""

from __future__ import annotations

import re
from itertools import permutations

from tidemark.llm.filter_audit import filter_audit

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def plain(rows, labels):
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = {}
    for i, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and i > first[text],
        }
        parts.setdefault(lang or "", []).append((fails, i in good, i in toxic))
    out = []
    for part, docs in parts.items():
        lines = []
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[0][f]]
                left = [d for d in left if not d[0][f]]
                failing = [d for d in docs if d[0][f]]
                alone = sum(sum(d[0].values()) == 1 for d in failing)
                lines.append([part, order, step, len(left), len(gone), len(failing) - len(gone), alone, sum(d[1] for d in gone), sum(d[2] for d in gone), f])
        total = {f: sum(x[4] for x in lines if x[9] == f) for f in "ABCDE"}
        out += [(*x[:9], total[x[9]]) for x in lines]
    return sorted(out)


def check(spark, rows, labels, extra=()):
    schema = "doc_id long, text string, lang string" + "".join(f", `{c}` string" for c in extra)
    docs = spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], schema).repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").repartition(2)
    got = filter_audit(docs, known)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == plain(rows, labels)


def test_odd_rows(spark):
    """Nulls in every column, repeated rows and ids, ties, long texts, labels that repeat, clashing names."""
    many = " ".join(f"w{k}" for k in range(200))
    rows = [
        (1, many, "en"), (2, many, "en"), (2, many, "en"), (1, many, "en"), (3, many, "de"), (None, many, "en"), (None, many, None),
        (4, None, "en"), (5, "", ""), (6, None, None), (7, "LOUD " * 150, "en"), (8, many + " #", "de"), (9, "é漢 " * 120, "de"),
        (10, many.upper() + "&", "fr"), (11, "x" * 3_000_000, "fr"), (12, many * 3000, "fr"), (2, "other", "en"), (13, "A" + "b" * 9, "en"),
    ]
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, None), (None, 1, 1), (7, None, 1), (8, 0, 0), (10, 1, 1), (4, 1, 0), (99, 1, 1)]
    check(spark, rows, labels, ["id", "part", "bits", "digest", "n", "good", "a.b", "first_id"])


def test_a_text_that_most_rows_share(spark):
    rows = [(i, "same words " * 60 if i % 3 else f"own {i}", "en" if i % 5 else None) for i in range(300)]
    check(spark, rows, [(i, i % 2, int(i % 7 == 0)) for i in range(0, 300, 4)])


def test_nothing_in_the_tables(spark):
    check(spark, [], [])
    check(spark, [(1, "a", "en")], [])
