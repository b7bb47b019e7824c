"""Archives: records by a plain reader of the format, pages by brute force, ranges one by one."""

from __future__ import annotations

import gzip
import hashlib
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.llm import warc

BIG = "<html>" + "same page " * 300
ROWS = [
    (1, "http://a.example/1", BIG), (2, "http://a.example/2", BIG), (7, "http://a.example/7", BIG), (3, "http://b.example/x y", "short"),
    (4, "http://b.example/4", "short"), (5, None, None), (6, "", ""), (None, "http://n.example/", BIG), (None, None, None),
    (8, "http://c.example/\r\nWARC-Type: x", "é漢" * 1000), (9, "http://c.example/9", "\r\n\r\nWARC/1.1\r\n\r\n" * 100),
    (7, "http://a.example/again", BIG), (10, "http://l.example/", "long " * 600_000), (11, "http://e.example/", "x" * 999), (12, "http://e.example/", "x" * 999),
    (13, "http://f.example/", "y" * 1000), (14, "http://f.example/", "y" * 1000), (None, "u", "lone " * 500), (None, "v", "lone " * 500),
]
SCHEMA = "page_id long, url string, html string, id string, `a.b` string, sha string, head string, bytes string, body string"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, *["x"] * 6) for r in ROWS], SCHEMA).repartition(3)


def plain(rows, least=1000):
    heads = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= least:
            heads[html] = max(i, heads.get(html, i))
    out = []
    for i, _, html in rows:
        raw, head = (html or "").encode(), heads.get(html)
        again = head is not None and head != i
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", head if again else None))
    return Counter(out)


def plain_records(path):
    """Records of an uncompressed archive, read from its beginning by lengths alone."""
    data, at = gzip.decompress(path.read_bytes()), 0
    while at < len(data):
        head, _, _ = data[at:].partition(b"\r\n\r\n")
        length = int(re.search(rb"\r\nContent-Length: (\d+)", head).group(1))
        begin = at + len(head) + 4
        assert head.startswith(b"WARC/1.1\r\n") and data[begin + length : begin + length + 4] == b"\r\n\r\n"
        yield head.decode(), data[begin : begin + length]
        at = begin + length + 4


def test_round_trip_of_odd_rows(spark, pages):
    got = warc.round_trip(pages)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert Counter(map(tuple, got.collect())) == plain(ROWS)


@pytest.mark.parametrize("hot", [0, 1])
def test_payloads_that_many_pages_share(spark, hot, monkeypatch):
    monkeypatch.setattr(warc, "HOT", hot)
    rows = [(i, f"http://x/{i}", BIG if i % 3 == 0 else "z" * 2000 if i % 3 == 1 else f"own {i} " * 200) for i in range(150)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7))
    assert Counter(map(tuple, got.collect())) == plain(rows)


def test_archives_are_valid_and_the_index_finds_every_record(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    index = warc.write_warc(pages, f"file://{tmp_path}")
    rows = index.collect()
    assert len(rows) == len(ROWS)
    files = sorted(Path(tmp_path, "archives").glob("*.warc.gz"))
    assert {f.name for f in files} == {r["file"] for r in rows}
    records = [r for f in files for r in plain_records(f)]
    assert len(records) == len(ROWS)
    kinds = Counter(re.search("WARC-Type: (.*)", head).group(1).strip() for head, _ in records)
    assert kinds == Counter(r["record_type"] for r in rows)
    ids = {re.search("WARC-Record-ID: (.*)", head).group(1).strip() for head, _ in records}
    for head, block in records:
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", http).group(1))
        if "WARC-Type: revisit" in head:
            assert not payload and re.search("WARC-Refers-To: (.*)", head).group(1).strip() in ids
            assert "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" in head
        else:
            assert len(payload) == size
    for r in rows:  # each range is one gzip member with one record
        raw = Path(tmp_path, "archives", r["file"]).read_bytes()[r["offset"] : r["offset"] + r["length"]]
        assert gzip.decompress(raw).startswith(b"WARC/1.1\r\n")


def test_chosen_records(spark, pages, tmp_path):
    index = warc.write_warc(pages, str(tmp_path))
    chosen = index.where(F.col("page").isin("3", "7", "10", "14") & (F.col("record_type") == "response"))
    got = {(r["page"], r["url"], bytes(r["payload"]).decode()) for r in warc.read_records(chosen, str(tmp_path)).collect()}
    quoted = {"http://b.example/x y": "http://b.example/x%20y"}
    assert got == {(str(i), quoted.get(u, u), h) for i, u, h in ROWS if i in (3, 7, 10, 14)}
    assert warc.read_records(index.limit(0), str(tmp_path)).collect() == []
    twice = warc.read_records(chosen.union(chosen), str(tmp_path))
    assert twice.count() == 2 * chosen.count()


def test_ranges_are_joined(monkeypatch):
    monkeypatch.setattr(warc, "GAP_BYTES", 10)
    monkeypatch.setattr(warc, "READ_BYTES", 100)
    ranges = [("a", 0, 20), ("a", 20, 20), ("a", 49, 10), ("a", 80, 10), ("a", 90, 60), ("a", 150, 500), ("b", 650, 5)]
    got = list(warc.joined_ranges(iter(ranges)))
    assert [(f, b, e, len(h)) for f, b, e, h in got] == [("a", 0, 59, 3), ("a", 80, 150, 2), ("a", 150, 650, 1), ("b", 650, 655, 1)]
    assert [(f, o, n) for f, _, _, held in got for o, n in held] == ranges
    assert list(warc.joined_ranges(iter([]))) == []


def test_no_pages(spark, pages):
    assert warc.round_trip(pages.limit(0)).collect() == []
