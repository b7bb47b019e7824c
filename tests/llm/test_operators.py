"""The operators against brute force, the library, exact round trips or held-out labels."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.conftest import DATA
from tidemark.llm import queries as registered
from tidemark.llm import bpe_codec
from tidemark.llm.bpe_codec import Codec, encode, join_runs
from tidemark.llm.components import connected
from tidemark.llm.mil_quality import encode_passages
from tidemark.llm.neardup import banding, near_duplicates, shingle_sets, superminhash
from tidemark.llm.quality_rules import learn, text_statistics
from tidemark.llm.queries import vocabulary
from tidemark.llm.token_counts import PieceCounts, count_text
from tidemark.llm.word_bpe import encode_symbols, load

LIBRARY = Tokenizer.from_file(vocabulary())


@pytest.fixture(scope="module")
def texts(spark):
    return {r[0]: r[1] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


# --- byte pairs ------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80) | st.text("aeinrst'sAB é<|endoftext|>İΣ１½\x1c\x85", max_size=80))
def test_codec_equals_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    own = Codec(vocabulary(), leaf=4)
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    assert own.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)
    assert count_text(text, PieceCounts(load(vocabulary()))) == len(ids)


@pytest.mark.parametrize("alphabet", ["a", "ab", "aeinrst", "thehereand", "a'srev e", "é1#日a ", "ab\n \u0301"])
def test_tree_concatenation_is_exact(alphabet):
    rng = random.Random(5)
    for leaf in (3, 16, 100):
        own = Codec(vocabulary(), leaf=leaf)
        for n in (1, 2, 3, 50, 700, 3000):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            assert own.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids
        assert own.joins > 30


def test_joins_within_a_word_are_exact():
    bpe, rng = load(vocabulary()), random.Random(6)
    for n in (2, 3, 50, 700):
        word = "".join(rng.choice("theinrsand") for _ in range(n))
        cut = n // 2
        runs = [encode_symbols(bpe.symbols(x), bpe.merges) for x in (word[:cut], word[cut:])]
        assert join_runs(*runs, bpe, first=1) == encode_symbols(bpe.symbols(word), bpe.merges)


def test_scan_and_heap_merge_alike():
    """Runs on both sides of the length from which pairs are kept in a heap."""
    from tidemark.llm.word_bpe import SCAN_SYMBOLS, MergeList

    bpe, rng = load(vocabulary()), random.Random(11)
    for n in (SCAN_SYMBOLS - 1, SCAN_SYMBOLS, SCAN_SYMBOLS + 1):
        for _ in range(50):
            symbols = bpe.symbols("".join(rng.choice("theinrsand") for _ in range(n)))
            run = MergeList(symbols, bpe.merges)
            merges = run.run()
            assert encode_symbols(symbols, bpe.merges) == run.result() and len(symbols) - merges == len(run.result())


def _long_texts() -> list[str]:
    rng = random.Random(7)
    words = ["".join(rng.choice("aeiourstnhld") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    special = "x" * 40_000 + "<|endoftext|>" + "don't " * 9_000 + "<|startoftext|>" * 5_000 + "end"
    return [
        " ".join(rng.choice(words) for _ in range(20_000)),  # 100 KB
        " ".join(rng.choice(words) for _ in range(900_000)),  # 5 MB
        "".join(rng.choice("theandingofur") for _ in range(100_000)),  # one word
        "".join(rng.choice("abcdefgh") for _ in range(1_000_000)),
        "日本語テキスト" * 30_000,
        "e\u0301İσΣ " * 20_000 + "#!?" * 40_000,
        special,
        "\n\t " * 60_000,
    ]


def test_long_texts_equal_the_library(spark):
    texts = _long_texts()
    rows = [(i, x) for i, x in enumerate(texts)] + [(6, texts[6]), (None, texts[0])]
    got = encode(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary()).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((i is None, i or 0) for i, _ in rows)
    for r in got:
        want = LIBRARY.encode(texts[r["doc_id"] or 0], add_special_tokens=False).ids
        assert r["ids"] == want
        assert r["decoded"] == LIBRARY.decode(want, skip_special_tokens=False)
        assert r["joins"] > 90
        assert Codec(vocabulary()).encode(texts[r["doc_id"] or 0]) == want
        assert count_text(texts[r["doc_id"] or 0], PieceCounts(load(vocabulary()))) == len(want)


def test_encoded_documents_equal_the_library(spark, texts):
    rows = registered.op2_bpe_codec(spark, DATA).collect()
    counts = {r["doc_id"]: r for r in registered.op3_token_counts(spark, DATA).collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = LIBRARY.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
        c = counts[r["doc_id"]]
        assert r["n_tokens"] == c["n_tokens"] == len(ids) and c["n_bytes"] == len(texts[r["doc_id"]].encode())
        assert c["over_limit"] == (len(ids) > 2048)
        assert (r["joins"] > 0) == (len(texts[r["doc_id"]]) > bpe_codec.LEAF_CHARS)


def test_most_of_a_table_is_joined(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    joins, longest = encode(docs, vocabulary()).selectExpr("sum(joins)", "max(joins)").first()
    assert joins > 1000 and longest > 16


# --- near duplicates ---------------------------------------------------------------------------


def brute_components(texts: dict, percent: int) -> dict:
    sets = {}
    for i, t in texts.items():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(texts)
    for a in order:
        for b in order:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}


@pytest.mark.parametrize("percent", [80, 85])
def test_components_equal_brute_force(spark, texts, percent):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r[0]: (r[1], r[2]) for r in near_duplicates(docs, percent).collect()}
    assert got == brute_components(texts, percent)


def test_large_groups_of_near_copies(spark):
    """More copies than a small bucket holds, at all distances from their source."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(900)}" for _ in range(130)]
    texts = {}
    for i in range(160):
        words = list(base)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        texts[i] = " ".join(words)
    texts |= {1000 + i: texts[3] for i in range(60)}
    # The source itself isn't among them.
    texts = {i: t for i, t in texts.items() if t != " ".join(base)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    for percent in (80, 85):
        got = {r[0]: (r[1], r[2]) for r in near_duplicates(docs, percent).collect()}
        assert got == brute_components(texts, percent)


def _copies_and_strays(n: int) -> list[tuple[int, str]]:
    """n near copies of a text, and strays that share many of their buckets but no link with most of them."""
    rng = random.Random(n)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(n + 12):
        words = list(base)
        if i < n:
            words[rng.randrange(200)] = f"x{i}"
        else:
            words[: 22 + i - n] = [f"y{i}_{k}" for k in range(22 + i - n)]
        rows.append((i, " ".join(words)))
    return rows


def test_work_on_a_group_grows_with_its_size(spark):
    """Members of one component aren't compared with each other again."""
    pairs = []
    for n in (300, 1200):
        rows, work = _copies_and_strays(n), {}
        got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85, work=work).collect()
        if n == 300:
            assert {r[0]: (r[1], r[2]) for r in got} == brute_components(dict(rows), 85)
        pairs.append(work["pairs"])
    assert pairs[1] < 6 * pairs[0], pairs


def test_documents_that_share_a_passage_are_not_compared_pair_by_pair(spark, monkeypatch):
    """Buckets of documents that have a passage in common and nothing more, and a few that are near copies of each other."""
    from tidemark.llm import neardup

    monkeypatch.setattr(neardup, "SMALL_BUCKET", 4)
    monkeypatch.setattr(neardup, "BLOCK_ITEMS", 900)
    passage = [f"p{k}" for k in range(90)]
    for n in (400,):
        rows = [(i, " ".join([*passage, *(f"o{i}_{k}" for k in range(110))])) for i in range(n)]
        rows += [(n + i, " ".join([*passage, *(f"o{i}_{k}" for k in range(108)), "x", f"y{i}"])) for i in range(0, 40, 7)]
        work: dict = {}
        got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85, work=work).collect()
        assert {r[0]: (r[1], r[2]) for r in got} == brute_components(dict(rows), 85)
        assert work["pairs"] < 12 * n, work


def test_many_strays_are_gathered(spark, monkeypatch):
    """Two large components and loose members in the same buckets, with the bound for rounds of gathering passed."""
    from tidemark.llm import neardup

    monkeypatch.setattr(neardup, "MANY_STRAYS", 8)
    monkeypatch.setattr(neardup, "SMALL_BUCKET", 4)
    monkeypatch.setattr(neardup, "BLOCK_MEMBERS", 16)
    monkeypatch.setattr(neardup, "BLOCK_ITEMS", 2000)
    rng = random.Random(4)
    base, rows = [f"w{k}" for k in range(150)], []
    for i in range(150):
        words = list(base)
        if i % 2:
            words[:13] = [f"z{k}" for k in range(13)]
        if i % 10 == 9:
            words[20:33] = [f"u{i}_{k}" for k in range(13)]
        words[rng.randrange(40, 150)] = f"x{i}"
        rows.append((i, " ".join(words)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == brute_components(dict(rows), 85)


def test_ids_beyond_the_broadcast_bound(spark, texts, monkeypatch):
    from tidemark.llm import neardup

    monkeypatch.setattr(neardup, "BROADCAST_IDS", 0)
    got = near_duplicates(spark.read.parquet(f"{DATA}/documents.parquet"), 80).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == brute_components(texts, 80)


def test_a_sample_against_all_rows(spark):
    """At sf0.01: every link of each 25th document with any other one is within a component."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r[0]: r[2] for r in near_duplicates(docs, 85).collect()}
    sets = {}
    for i, t in docs.select("doc_id", "text").collect():
        sets[i] = set(shingle_sets([t or ""], 5)[0].tolist())
    for a in sorted(sets)[::25]:
        for b, other in sets.items():
            both = len(sets[a] & other)
            if a != b and both and 100 * both >= 85 * (len(sets[a]) + len(other) - both):
                assert got[a] == got[b]


def test_checkpoints_are_deleted(spark, tmp_path):
    place = tmp_path / "shared"
    before = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(place))
    try:
        near_duplicates(spark.read.parquet(f"{DATA}/documents.parquet"), 85).collect()
        assert len([x for x in place.glob("*/rdd-*")]) <= 4
    finally:
        spark.sparkContext.setCheckpointDir(before)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    shared, own = rng.integers(1, 1 << 62, 400, np.uint64), rng.integers(1, 1 << 62, 200, np.uint64)
    a, b = np.concatenate([shared, own[:100]]), np.concatenate([shared, own[100:]])
    sig = superminhash(np.concatenate([a, b, a[:0]]), np.array([len(a), len(b), 0]), 128)
    assert abs((sig[0] == sig[1]).mean() - 400 / 600) < 0.15
    assert (sig[2] == np.iinfo(np.uint64).max).all()
    # Every position holds the least offer of all shingles, wherever the work was cut.
    parts = [superminhash(x, np.array([len(x)]), 128)[0] for x in (a[:1], a[1:250], a[250:])]
    assert (np.minimum.reduce(parts) == sig[0]).all()
    assert banding(0.85) == (25, 5) and banding(0.8) == (32, 4)


def test_shingle_counts():
    items, sizes = shingle_sets(["a b c d e f", "A B c d e", "a b c d e a b c d e", "x", "", " "], 5)
    assert sizes.tolist() == [2, 1, 5 + 0, 1, 0, 0]
    assert items[2] in items[:2]


def test_components_of_a_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(2).shuffle(order)
    links = [(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1001, 1002), (None, 5)]
    got = dict(map(tuple, connected(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()))
    assert got == {**{i: 0 for i in range(1, n)}, 1001: 1000, 1002: 1000}
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []


# --- learned operators -------------------------------------------------------------------------


def statistics_of(text: str) -> dict:
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return dict(
        n_words=len(w), word_chars=sum(map(len, w)), n_symbols=len(re.findall(r"[#*$%&|<>]", text)),
        n_dup_lines=len(lines) - len(set(lines)), n_repeat_words=len(covered),
    )


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab \n\t\x0b\x1c\x85é#|<", max_size=60), max_size=6))
def test_statistics_equal_brute_force(texts):
    got = text_statistics(texts)
    for i, t in enumerate(texts):
        assert {k: int(got[k][i]) for k in statistics_of(t)} == statistics_of(t)


def test_rules_on_documents(spark, texts):
    rows = {r["doc_id"]: r for r in registered.op6_quality_rules(spark, DATA).collect()}
    assert rows.keys() == texts.keys()
    for i, t in texts.items():
        want = statistics_of(t)
        assert {k: rows[i][k] for k in want} == want
        failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        assert rows[i]["base_failed"] == failed and not (failed and rows[i]["kept"])
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality").collect()}
    good = [i for i, q in labels.items() if q == 1 and not rows[i]["base_failed"]]
    bad = [i for i, q in labels.items() if q == 0]
    assert np.mean([rows[i]["kept"] for i in good]) > 0.95
    assert np.mean([rows[i]["kept"] for i in bad]) < 0.5


def test_covering_finds_a_conjunction():
    rng = np.random.default_rng(0)
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words symbols_per_char upper_per_char marks_per_word repeats_per_word chars_per_word dup_lines_share"
    rows = {k: rng.random(3000) for k in names.split()}
    bad = (rows["n_symbols"] > 0.7) & (rows["upper_per_char"] < 0.4)
    rules = learn(rows, bad)
    assert rules
    caught = np.zeros(3000, bool)
    for rule in rules:
        inside = np.ones(3000, bool)
        for c in rule:
            inside &= c.holds(rows)
        caught |= inside
    assert caught[bad].mean() > 0.9 and bad[caught].mean() > 0.9
    assert learn(rows, np.zeros(3000, bool)) == []


def _held(spark, rows, label, modulus, fold):
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    out = [(labels[r["doc_id"]], r) for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == fold)
        assert 0 <= r["score"] <= 1
    return out


def test_rows_of_least_hash(spark):
    from pyspark.sql import functions as F

    from tidemark.llm.labelled import least_hashed, labelled_texts

    rows = spark.range(30_000).selectExpr("id as doc_id", "cast(id % 2 as int) as _label")
    want = [r[0] for r in rows.orderBy(F.xxhash64("doc_id")).limit(500).collect()]
    assert [r["doc_id"] for r in least_hashed(rows, "doc_id", 500, "_label")] == want
    one = rows.selectExpr("7L as doc_id", "_label")  # a single key: all or none are below any bound
    assert len(least_hashed(one, "doc_id", 500, "_label")) == 500
    assert len(least_hashed(rows.limit(10), "doc_id", 500, "_label")) == 10
    # A repeated id doesn't widen the sample, and long texts take their part of the budget.
    docs = rows.selectExpr("doc_id % 3 as doc_id", "concat('text ', doc_id) as text")
    docs = docs.union(spark.createDataFrame([(4, "x" * 200_000)], "doc_id long, text string"))
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 0), (4, 1)], "doc_id long, quality int")
    texts, good, left_out = labelled_texts(docs, labels, "quality", (3, 9), 40, "doc_id", "text")
    assert len(texts) == len(good) == 40 and left_out == 0
    texts, good, left_out = labelled_texts(docs.where("doc_id != 0"), labels, "quality", (3, 9), 30_000, "doc_id", "text")
    assert max(map(len, texts)) == 200_000 and left_out == 0
    texts, good, left_out = labelled_texts(docs, labels, "quality", (3, 9), 30_000, "doc_id", "text", budget=150_000)
    assert max(map(len, texts)) < 20 and left_out > 0 and sum(map(len, texts)) <= 150_000
    assert 0.4 < good.mean() < 0.6


def test_byte_budgets():
    from tidemark.llm.labelled import within

    assert within([], [], 10) == []
    assert within([5, 5, 5, 5], [1, 1, 0, 0], 10) == [0, 2]
    assert within([5, 5, 5, 5], [1, 1, 1, 1], 10) == [0, 1]  # one class may use what the other leaves
    assert within([100, 1, 1], [1, 0, 1], 10) == [1, 2]


def test_attention_gradients():
    """Each weight's gradient against the difference quotient of the loss."""
    from tidemark.llm.mil_quality import N_FEATURES, Model, train

    rng = np.random.default_rng(6)
    passages = np.array([1, 3, 2])
    features, good = rng.normal(size=(6, N_FEATURES)), np.array([1.0, 0.0, 1.0])
    model = train(features.astype(np.float32), passages, good, epochs=1)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}

    def loss(m: Model) -> float:
        p = m.forward(features, passages)["score"]
        return float(-(good * np.log(p) + (1 - good) * np.log(1 - p)).sum())

    passed = model.forward(features, passages)
    starts = np.cumsum(passages) - passages
    assert np.allclose(np.add.reduceat(passed["attention"], starts), 1)
    for name, g in model.gradients(passed, passed["score"] - good).items():
        flat = model.weights[name].reshape(-1)
        for at in rng.integers(0, flat.size, 5):
            kept, step = flat[at], 1e-5
            flat[at] = kept + step
            high = loss(model)
            flat[at] = kept - step
            low = loss(model)
            flat[at] = kept
            assert (high - low) / (2 * step) == pytest.approx(np.asarray(g).reshape(-1)[at], abs=1e-5), name


def test_attention_against_a_loop_over_passages(texts):
    """Scores of the batch form against one passage after the other."""
    import math

    from tidemark.llm.mil_quality import encode_passages, train

    some = [t or "" for _, t in sorted(texts.items())][:40]
    features, passages = encode_passages(some)
    model = train(features, passages, np.arange(40) % 2, epochs=2)
    w, at = model.weights, 0
    scores = model.forward(features, passages)["score"]
    for n, score in zip(passages, scores):
        hidden, energy = [], []
        for row in features[at : at + n]:
            x = np.clip((row - model.mean) / model.scale, -8, 8)
            h = np.tanh(x @ w["W"] + w["b"])
            gate = 1 / (1 + np.exp(-(h @ w["U"])))
            hidden.append(h)
            energy.append(float((gate * np.tanh(h @ w["V"])) @ w["a"]))
        weigh = [math.exp(e - max(energy)) for e in energy]
        z = sum(a / sum(weigh) * h for a, h in zip(weigh, hidden))
        assert score == pytest.approx(1 / (1 + math.exp(-(float(z @ w["c"]) + float(w["d"][0])))), abs=1e-5)
        at += n


def test_log_count_ratios_and_scores_against_a_plain_version():
    from tidemark.llm import toxicity

    rng = random.Random(9)
    good = ["sunny meadow walk", "quiet river song", "gentle morning light"]
    bad = ["vile stupid fool", "awful stupid brute", "vile rotten fool"]
    texts = [" ".join(rng.sample((bad if i % 3 == 0 else good), 2)) for i in range(90)]
    toxic = np.array([i % 3 == 0 for i in range(90)], float)
    model = toxicity.train(texts, toxic)

    def grams(text):
        out = set()
        for word in text.lower().split():
            marked = f"<{word.strip(toxicity.PUNCTUATION)}>"
            out |= {marked[i : i + n] for n in toxicity.NGRAMS for i in range(len(marked) - n + 1)}
        return out

    slot_of = {g: toxicity._slots([g], None)[0] for t in texts for g in grams(t)}
    # A string's last n-gram of its own length is the string itself.
    slot_of = {g: [s for s in x if s in toxicity._slots([g], None)[0]][-1] for g, x in slot_of.items()}
    held = {}
    for t, y in zip(texts, toxic):
        for s in {slot_of[g] for g in grams(t)}:
            n = held.setdefault(s, [0, 0])
            n[int(y)] += 1
    kept = dict(zip(model.slots.tolist(), model.weights.tolist()))
    for s, (q, p) in held.items():
        ratio = np.log((p + 1) / (toxic.sum() + 2)) - np.log((q + 1) / ((1 - toxic).sum() + 2))
        stands_out = p + q >= toxicity.LEAST_DOCS and abs(ratio) > 2.5 * np.sqrt(1 / (p + 1) + 1 / (q + 1))
        assert (s in kept) == stands_out
    score = model.scorer()
    for t in texts[:12]:
        z = model.bias + sum(kept.get(s, 0.0) for s in {slot_of[g] for g in grams(t)})
        assert score([t])[0] == pytest.approx(1 / (1 + np.exp(-z)))
    assert (score(texts) >= 0.5).tolist() == (toxic > 0).tolist()


def test_quality_on_held_out_labels(spark):
    rows = registered.op1_mil_quality(spark, "/root/testdata/sf0.01").collect()
    held = _held(spark, rows, "quality", 3, 1)
    assert np.mean([y == r["predicted"] for y, r in held]) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_toxicity_on_held_out_labels(spark):
    rows = registered.op9_toxicity(spark, "/root/testdata/sf0.01").collect()
    held = _held(spark, rows, "toxic", 4, 2)
    caught = [r["predicted"] for y, r in held if y == 1]
    assert caught and np.mean(caught) > 0.9
    assert np.mean([r["predicted"] for y, r in held if y == 0]) < 0.1


@pytest.mark.parametrize("size", [700, 4096])
def test_slices_of_long_texts_change_nothing(texts, monkeypatch, size):
    """Hashes, passages, statistics and n-grams of texts in slices against those of whole texts."""
    from tidemark.llm import common, mil_quality, quality_rules, toxicity

    rng = random.Random(size)
    some = [max(texts.values(), key=lambda t: len(t or "")), "x" * 5000, " " * 900 + "ab " * 3000 + "\n" * 800 + "z" * 1500]
    some.append("\n".join(rng.choice(["same line here", "other", "", "  ", "q" * 900]) for _ in range(400)))
    whole = [
        (common.word_hashes([t.encode()])[0].tolist(), encode_passages([t])[0], text_statistics([t]), toxicity.Slots().of([t]))
        for t in some
    ]
    for module in (common, mil_quality, quality_rules):
        monkeypatch.setattr(module, "SLICE_BYTES", size)
    monkeypatch.setattr(quality_rules, "SORTED_WINDOWS", size)
    monkeypatch.setattr(toxicity, "_SLICE_CHARS", size)
    monkeypatch.setattr(toxicity, "_SLOT_CHARS", size)
    for t, (hashes, passages, counts, slots) in zip(some, whole):
        assert common.word_hashes([t.encode()])[0].tolist() == hashes
        assert np.array_equal(encode_passages([t])[0], passages)
        assert {k: v.tolist() for k, v in text_statistics([t]).items()} == {k: v.tolist() for k, v in counts.items()}
        assert toxicity.Slots().of([t]) == slots


def test_passages_do_not_depend_on_the_batch(texts):
    some = list(texts.values())[:40] + ["", " ", "one"]
    together, counts = encode_passages(some)
    apart = [encode_passages([t]) for t in some]
    assert counts.tolist() == [int(n[0]) for _, n in apart]
    np.testing.assert_allclose(together, np.concatenate([x for x, _ in apart]), rtol=1e-5)


# --- mixing --------------------------------------------------------------------------------------


def test_mix_reaches_its_targets(spark, texts):
    rows = registered.op10_source_mixing(spark, "/root/testdata/sf0.01").collect()
    source = {r[0]: r[1] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source").collect()}
    total = sum(r["size"] for r in rows)
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        s = source[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    # Targets by repeated sharing.
    names = sorted(sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    fixed: dict = {}
    while True:
        free = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / max(1, sum(weight[s] for s in free))
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            break
        fixed |= {s: 3.0 * sizes[s] for s in over}
    for s in names:
        want = fixed.get(s, level * weight[s])
        assert target[s] == pytest.approx(want)
        assert taken[s] == pytest.approx(want, rel=0.02)


def test_running_sums_over_many_stretches(spark):
    from tidemark.llm.mixing import sums_before

    rng = random.Random(8)
    rows = [(s, b, rng.randrange(9)) for s in ("x", None, "y") for b in rng.sample(range(400), 150)]
    df = spark.createDataFrame(rows, "src string, bucket long, n long").where("src is not null")
    for r in sums_before(df, "src", "bucket", "n", 16).collect():
        assert r["start"] == sum(n for s, b, n in rows if s == r["src"] and b < r["bucket"])


def test_slots_against_a_plain_loop(spark):
    """Every slot's source, its rank and what is taken of each document, one after the other."""
    import math

    from tidemark.llm import mixing

    targets = [("a", 0, 400, 300.0), ("b", 1, 500, 900.0), ("c", 2, 300, 0.0)]
    df = spark.createDataFrame(targets, "source string, src int, source_size long, target double")
    got = sorted((r["slot"], r["src"], r["rank"]) for r in mixing.schedule(df, 3000).collect())
    want, ranks, edge = [], {0: 0, 1: 0}, 300.0 / 1200.0
    for i in range(3000):
        x = (i + 1) * mixing.GOLDEN
        src = 0 if x - math.floor(x) < edge else 1
        want.append((i, src, ranks[src]))
        ranks[src] += 1
    assert got == want

    docs = [(i, f"s{i % 3}", " ".join(["w"] * (1 + i * 7 % 23))) for i in range(90)]
    rows = mixing.mix(spark.createDataFrame(docs, "doc_id long, source string, text string"), block_words=1).collect()
    # With blocks of one word a document is taken as often as its source's target covers its place.
    sizes = {i: len(t.split()) for i, _, t in docs}
    for s in range(3):
        own = [r for r in rows if r["doc_id"] % 3 == s]
        target, total = math.floor(own[0]["target"] + 0.5), sum(sizes[r["doc_id"]] for r in own)
        assert sum(r["taken"] for r in own) == target
        full, rest = divmod(target, total)
        partial = [r for r in own if r["taken"] not in (full * r["size"], (full + 1) * r["size"])]
        assert len(partial) <= 1
        assert all(full * r["size"] <= r["taken"] <= (full + 1) * r["size"] for r in own)


def test_targets_stop_at_three_times_the_source(spark):
    from tidemark.llm.mixing import mix

    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(9000, "a"), (10, "b"), (20, "c"), (3000, None), (0, "d")])]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["target"] == 30 and by[2]["target"] == 60 and by[4]["target"] == 0
    assert by[0]["target"] + by[3]["target"] == pytest.approx(12030 - 90)
    assert all(r["taken"] == pytest.approx(r["target"], rel=0.05, abs=3) for r in got)


@pytest.mark.parametrize("words", [1, 4096])
def test_small_sources_get_their_targets_at_every_block_size(spark, monkeypatch, words):
    from tidemark.llm import mixing

    monkeypatch.setattr(mixing, "LEAST_SLOTS", 1)
    sizes = {"a": 200, "b": 500, "c": 3000, "d": 60_000, "e": 40_000}
    rows = [(i, "w " * (n // 10), s) for i, (s, n) in enumerate((s, n) for s, n in sizes.items() for _ in range(10))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    source = {i: s for i, _, s in rows}
    got = mixing.mix(docs, block_words=words).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    assert target["a"] == 600 and target["b"] == 1500 and target["c"] == 9000
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 0.5
    copies = Counter(r["source"] for r in mixing.mixed_documents(docs).select("source").collect())
    assert copies["a"] == 30 and copies["b"] == 30


# --- licences --------------------------------------------------------------------------------------


def test_notices_in_mid_line_wrapped_and_full_texts(spark):
    from tidemark.llm.license_scan import scan_licenses
    from tidemark.llm.license_texts import TEXTS

    wrapped = re.sub("(.{60}) ", r"\1\n * ", TEXTS[0][1])
    cases = [
        ("Copyright 2020 Jane Doe. Licensed under the Apache License, Version 2.0.", "Apache-2.0", 1),
        ("Copyright (c) 2020 Jane Doe. Released under the MIT License.", "MIT", 1),
        ("This page is licensed under CC BY 4.0.", "CC-BY-4.0", 1),
        ("All rights kept. This work is licensed under the GNU General\nPublic License, version 3 or later", "GPL-3.0", 1),
        ("MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\n of this software "
         "and associated documentation files (the Software), to deal in the Software", "MIT", 1),
        ("word " * 500 + "Licensed under CC BY-SA 4.0 " + "word " * 500 + "Released under the ISC License", "ISC", 2),
        ("Redistribution and use in source and binary forms, with or\nwithout modification, are permitted provided that "
         "the following\nconditions are met:", "BSD-2-Clause", 1),
        ("a licensed driver under the version", None, 0),
        (None, None, 0),
        ("", None, 0),
        ("intro " * 300 + wrapped + " outro" * 300, "MIT", 1),
        ("license", None, 0),
    ]
    docs = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in scan_licenses(docs).collect()}
    for i, (_, name, n) in enumerate(cases):
        assert (got[i]["license"], got[i]["n_matches"]) == (name, n), got[i]
    assert got[1]["word_no"] == 6 and got[1]["dice"] == 1.0
    assert got[10]["word_no"] == 301 and got[10]["dice"] == 1.0


def brute_scan(text: str, templates: list, threshold: float = 0.8):
    """All windows of all templates, one by one, as (matches, licence, coefficient, first word)."""
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    pairs, found = [f"{a} {b}" for a, b in zip(words, words[1:])], []
    for k, (name, grams) in enumerate(templates):
        best = None
        for a in range(len(pairs)):
            for b in range(a, min(len(pairs), a + int(len(grams) * (2 - threshold) / threshold + 1e-9))):
                inside = set(pairs[a : b + 1])
                dice = 2 * len(inside & set(grams)) / (len(inside) + len(grams))
                if best is None or (-dice, b - a, a) < best[:3]:
                    best = (-dice, b - a, a, b)
        if best and -best[0] >= threshold - 1e-9:
            found.append((best[0], k, best[1], best[2], best[3], name))
    counts = [m for m in found if not any(o < m and o[3] <= m[4] and m[3] <= o[4] for o in found)]
    if not counts:
        return 0, None, None, None
    top = min(counts)
    return len(counts), top[5], round(-top[0], 6), top[3] + 1


def test_notices_equal_all_windows(spark):
    from tidemark.llm.license_scan import bigrams, scan_licenses, template_words
    from tidemark.llm.license_texts import HEADERS, SENTENCES

    some = SENTENCES + HEADERS
    rng, templates = random.Random(5), [(n, bigrams(template_words(t))) for n, t in some]
    texts = []
    for _ in range(80):
        text = []
        for _ in range(rng.randrange(1, 3)):
            words = template_words(rng.choice(some)[1])
            for _ in range(rng.randrange(4)):  # near misses among them
                words[rng.randrange(len(words))] = rng.choice(["other", "license", "the"])
            text += ["word"] * rng.randrange(4) + words + ["more"] * rng.randrange(4)
        texts.append("".join(w + rng.choice([" ", " ", "\n", ", ", " * "]) for w in text))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame(some, "name string, text string")
    by_name = sorted(some)
    for given, order in ((some, templates), (table, [(n, bigrams(template_words(t))) for n, t in by_name])):
        got = scan_licenses(docs, templates=given).collect()
        assert len(got) == len(texts)
        for r in got:
            assert tuple(r)[1:] == brute_scan(texts[r["doc_id"]], order), texts[r["doc_id"]]


def test_registered_sql(spark):
    """Each query with SQL against DuckDB on the same tables."""
    import duckdb

    for name, sql in registered.oracle_sql().items():
        con = duckdb.connect()
        for table in ("documents", "embeddings", "pages"):
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
        df = getattr(registered, name)(spark, DATA)
        want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()
        key = lambda r: tuple((x is None, str(x)) for x in r)
        assert sorted(map(key, want)) == sorted(key(tuple(r)) for r in df.collect()), name
