"""Operators on small inputs, streaming forms against batch forms."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark.operators import audit, browse, graph, memory, search, sessions, writes
from tidemark.sources import tables
from tidemark.streaming import aggregate

T0 = dt.datetime(2026, 1, 17, 12)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_cursor_round_trip_and_pages(spark):
    assert browse.decode_cursor(browse.encode_cursor("2024-01-01 00:00:00", 7)) == ("2024-01-01 00:00:00", 7)
    rows = spark.createDataFrame([(i, at(i // 3)) for i in range(20)], "event_id long, ts timestamp")
    seen, cursor = [], None
    while True:
        page = browse.page(rows, browse.EventFilter(), 6, cursor).collect()
        if not page:
            break
        seen += [r["event_id"] for r in page]
        cursor = browse.encode_cursor(str(page[-1]["ts"]), page[-1]["event_id"])
    assert seen == list(range(19, -1, -1))


def test_thread_gap(spark):
    rows = [("u", "e1", at(0), "Chrome", "Docs"), ("u", "e2", at(300), "Chrome", "Docs"), ("u", "e3", at(4200), "Terminal", "bash")]
    df = spark.createDataFrame(rows, "u string, e string, ts timestamp, app string, title string")
    got = sessions.threads(df, "u", "ts", "e", "app", "title", minutes=30)
    assert [r["thread"] for r in got.orderBy("e").collect()] == [0, 0, 1]


def test_fusion(spark):
    a = spark.createDataFrame([("E1", 1), ("E2", 2)], "id string, rank int")
    b = spark.createDataFrame([("E1", 1)], "id string, rank int")
    got = search.fuse([a, b], "id").collect()
    assert [(r["id"], r["score"]) for r in got] == [("E1", pytest.approx(2 / 61, abs=1e-8)), ("E2", pytest.approx(1 / 62, abs=1e-8))]
    c = spark.createDataFrame([("b", 1), ("a", 2)], "id string, rank int")
    d = spark.createDataFrame([("a", 1), ("b", 2)], "id string, rank int")
    assert [r["id"] for r in search.fuse([c, d], "id").collect()] == ["a", "b"]


def test_hotness_half_life_and_pins(spark):
    rows = spark.createDataFrame([("x", at(0), 1.0)], "i string, ts timestamp, w double")
    got = memory.hotness(rows, "i", "ts", F.col("w"), F.lit(at(3600))).first()["score"]
    want = sum(memory.WEIGHTS[n] * 2 ** (-3600 / h) for n, h in memory.HALF_LIVES.items())
    assert got == pytest.approx(want, abs=1e-6)
    pins = spark.createDataFrame([(f"p{i}", "hard", i) for i in range(5)], "i string, pin_level string, pin_rank int")
    kept = memory.select_pins(pins, {"hard": 3}, "i").where("kept").orderBy("i").collect()
    assert [r["i"] for r in kept] == ["p0", "p1", "p2"]
    assert memory.quota_targets(21) == {"hot": 9, "recent": 7, "warm": 4, "cool": 2} or sum(memory.quota_targets(21).values()) == 21


def brute_pack(rows, cards, budget, per_kind):
    order = {k: i for i, k in enumerate(memory.TYPE_ORDER)}
    out, used, seen = [], 0, {}
    for r in sorted(rows, key=lambda r: (-r[2], order.get(r[1], len(order)), r[0])):
        if len(out) >= cards:
            break
        if seen.get(r[1], 0) >= per_kind:
            continue
        if used + r[3] > budget:
            break
        used += r[3]
        seen[r[1]] = seen.get(r[1], 0) + 1
        out.append(r[0])
    return out


def test_packing_equals_a_loop(spark):
    rng = random.Random(1)
    for _ in range(4):
        rows = [(i, rng.choice(memory.TYPE_ORDER), rng.randrange(5) / 4, rng.randrange(1, 400)) for i in range(40)]
        df = spark.createDataFrame(rows, "id int, kind string, score double, tokens int")
        got = memory.pack(df, "id", "kind", "tokens", cards=6, budget=1000).orderBy("position").collect()
        assert [r["id"] for r in got] == brute_pack(rows, 6, 1000, 2)


def test_rate_limit_equals_a_loop(spark):
    events = tables.table(spark, DATA, "events").select("user_id", "event_id", "ts")
    got = {r["event_id"]: r["accepted"] for r in memory.rate_limited(events, ["user_id"], "ts", 50_000, "event_id").collect()}
    last: dict = {}
    for r in events.orderBy("user_id", "ts", "event_id").collect():
        ok = r["user_id"] not in last or (r["ts"] - last[r["user_id"]]).total_seconds() >= 50_000
        if ok:
            last[r["user_id"]] = r["ts"]
        assert got[r["event_id"]] == ok


def test_ledger_detects_changes(spark):
    rows = spark.createDataFrame([("a", i, f"p{i}") for i in range(4)] + [("b", 0, "q")], "k string, n int, p string")
    chained = audit.chain(rows, "k", F.col("p"), "n")
    assert audit.verify_chain(chained, "k", F.col("p"), "n").where("not valid").count() == 0
    broken = chained.withColumn("p", F.when((F.col("k") == "a") & (F.col("n") == 2), "x").otherwise(F.col("p")))
    assert [r["n"] for r in audit.verify_chain(broken, "k", F.col("p"), "n").where("not valid").collect()] == [2]


def test_conflicts_coverage_and_modes(spark):
    rows = [
        ("once", at(0), "Cost: $1,000"), ("once", at(0), "cost $1000"), ("once", at(0), "Status: open"), ("once", at(0), "status closed"),
        ("later", at(0), "Status: open"), ("later", at(9), "status closed"), ("other", at(0), "price 5"), ("other", at(0), "price 7"),
        ("other", at(5), "nothing"), ("same", at(0), "version 2"),
    ]
    found = audit.conflicts(spark.createDataFrame(rows, "pack string, ts timestamp, t string"), "pack", "ts", "t")
    got = {r["pack"]: (r["fields"], r["conflict"], r["changed"]) for r in found.collect()}
    assert got == {
        "once": (["status"], True, False), "later": (["status"], False, True), "other": (["amount"], False, True),
        "same": ([], False, False),
    }
    one = spark.range(1)
    known = F.array(F.lit("E1"), F.lit("E2"))
    share = lambda s, **k: one.select(audit.coverage(F.lit(s), known, **k)).first()[0]
    assert share("First sentence. [E1] Second sentence. [E1]") == 1.0 and share("One. Two [E1].") == 0.5 and share("") == 0.0
    assert share("One [E9]. Two [E2].") == 0.5  # E9 is no evidence
    assert share("One [E2]. [E1] Two.") == 1.0  # the one before has a citation of its own
    assert share("No evidence here. Two [E1].", meta_counts=False) == 1.0
    sentences = one.select(audit.cited_sentences(F.lit("One. [E1] Two. [E2]"), known)).first()[0]
    assert [(s["text"], s["citations"]) for s in sentences] == [("One.", ["E1"]), ("[E1] Two.", ["E2"])]
    mode = audit.answer_mode(F.lit(False), F.lit(False), F.lit(0.7))
    assert one.select(mode).first()[0] == "NORMAL"
    assert one.select(audit.entailed(F.lit("cost 5.5"), F.lit("5.5 and 7"))).first()[0]


def test_expansion_is_directed_ordered_and_bounded(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60), rng.choice("ab"), float(rng.randrange(3))) for _ in range(400)]
    df = spark.createDataFrame(edges, "src int, dst int, relation string, weight double")
    for most in (1, 2, 10, 40, 200):
        visited, frontier, full = {0, 1}, [0, 1], False
        depths = {0: 0, 1: 0}
        for depth in (1, 2):
            step = []
            for src, dst, relation, weight in sorted(edges, key=lambda e: (e[2], -e[3], e[1])):
                if full or src not in frontier or dst in visited:
                    continue
                visited.add(dst)
                depths[dst] = depth
                step.append(dst)
                full = len(visited) >= most
            frontier = step
        start = spark.createDataFrame([(0,), (1,)], "node int")
        got = {r["node"]: r["depth"] for r in memory.expand(df, start, 2, most=most).collect()}
        assert got == depths, most


def test_exact_quantiles_and_ranks(spark):
    import numpy as np

    from tidemark.operators import ordered

    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(size=9000), "b": rng.integers(0, 4, 8000).astype(float), "c": np.array([7.0]), "d": np.arange(4100.0) ** 3}
    rows = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v] + [("a", None), ("e", None)], "k string, x double")
    got = {(r["k"], r["level"]): r["value"] for r in ordered.exact_quantiles(rows, "x", ["k"], (0.0, 0.5, 0.95, 1.0), 200).collect()}
    assert got == {(k, q): pytest.approx(np.quantile(v, q)) for k, v in groups.items() for q in (0.0, 0.5, 0.95, 1.0)}
    ranked = {(r["k"], r["x"]): r["rank"] for r in ordered.rank_over_all(rows.where("x is not null"), "x", buckets=8).collect()}
    every = np.sort(np.concatenate(list(groups.values())))[::-1]
    for (_, x), rank in list(ranked.items())[::97]:
        assert rank == 1 + int((every > x).sum())


def test_folds_go_through_large_keys_in_order(spark):
    from tidemark.operators.folds import fold_in_order

    rows = spark.range(50_000).selectExpr("id % 2 as k", "id as n", "cast(id as string) as `odd name`")
    out = fold_in_order(rows, ["k"], ["n"], lambda s, g, r: (s + 1, s + 1), "nth", "long", 0)
    assert out.where("nth <> n div 2 + 1").count() == 0 and out.count() == 50_000
    assert out.columns == ["k", "n", "odd name", "nth"]


def test_plans_have_no_window_over_all_candidates(spark):
    """Normalisation over all candidates is an aggregate; only limited lists are ordered in one task."""
    from tidemark.plans import catalogue

    for name in ("hybrid_score", "threshold_filter", "memory_rank"):
        plan = catalogue.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan, name


def test_touches_in_batches_out_of_order(spark, tmp_path):
    schema = "user_id long, ts timestamp"
    parts = [[(1, at(100)), (1, at(0)), (1, at(30))], [(1, at(50)), (1, at(400)), (2, at(5))]]
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p={n}"))
    out = []
    for n in range(2):  # one run for each batch
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / (f"p=[0-{n}]")))
        touches = aggregate.accepted_touches(stream, "user_id", "ts", 60)
        aggregate.run_available(touches, lambda b, i: out.extend(map(tuple, b.collect())), str(tmp_path / "state"))
    got = sorted((u, (t - T0).total_seconds(), ok, why) for u, t, ok, why in out)
    assert got == [
        (1, 0.0, True, None), (1, 30.0, False, "rate_limited"), (1, 50.0, False, "out_of_order"), (1, 100.0, True, None),
        (1, 400.0, True, None), (2, 5.0, True, None),
    ]


def test_percentiles_and_quantiles(spark):
    rows = spark.createDataFrame([(float(i),) for i in range(1, 6)], "x double")
    got = audit.summary(rows, "x").first()
    assert (got["median"], got["p95"]) == (3.0, 4.8)
    values = spark.createDataFrame([(float(x),) for x in (5, 7, 12, 18, 25, 29)], "x double")
    buckets = audit.histogram(values, "x", [10, 20, 30])
    assert audit.histogram_quantile(buckets, 0.5).first()[0] == 15.0
    assert audit.histogram_quantile(buckets, 0.95).first()[0] == pytest.approx(28.5)


def test_writes(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 0), (1, "z", 0)], "k int, v string, t int")
    got = {r["k"]: r["v"] for r in writes.latest_wins(old, new, ["k"], F.desc("t")).collect()}
    assert got == {1: "a", 2: "c", 3: "d"}
    assert {r["k"]: r["v"] for r in writes.insert_ignore(old, new, ["k"]).collect()} == {1: "a", 2: "b", 3: "d"}


def test_expansion_stops_at_its_depth(spark):
    rows = [(a, b, "r", 1.0) for a, b in (("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"))]
    edges = spark.createDataFrame(rows, "src string, dst string, relation string, weight double")
    start = spark.createDataFrame([("a",)], "node string")
    got = dict(map(tuple, memory.expand(edges, start, 2).collect()))
    assert got == {"a": 0, "b": 1, "c": 2}  # edges are followed one way


def test_readers(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("iteration\tms\n1\t10\n# x\n\n2\t20\n")
    assert sorted(r["ms"] for r in tables.timings(spark, str(tmp_path / "t.tsv")).collect()) == [10.0, 20.0]
    (tmp_path / "log.jsonl").write_text('{"ts":"2026-01-01","component":"a","value":1}\nnot json\n')
    got = tables.perf_log(spark, str(tmp_path / "log.jsonl")).collect()
    assert got[0]["component"] == "a" and got[1]["raw"] == "not json"
    (tmp_path / "cases.jsonl").write_text('{"id":"1","query":"roadmap","expected_evidence_ids":["EVT-1"],"expected_no_evidence":false}\n')
    assert tables.eval_cases(spark, str(tmp_path / "cases.jsonl")).first()["expected_evidence_ids"] == ["EVT-1"]
    events = tables.table(spark, DATA, "events")
    manifest = tables.export_jsonl(events, str(tmp_path / "out"), "2024-01-31", 10).first()
    assert spark.read.json(str(tmp_path / "out")).count() == manifest["events"] > 0


# --- streams -------------------------------------------------------------------------------------


def test_streams_equal_batches(spark, tmp_path):
    rng = random.Random(4)
    rows = sorted((at(rng.randrange(4000) * 2), rng.randrange(3), rng.choice(["click", "view"])) for _ in range(300))
    schema = "ts timestamp, user long, kind string"
    for k in range(3):
        part = spark.createDataFrame(rows[k * 100 : k * 100 + 100], schema)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    end = spark.createDataFrame([(at(10**6), 99, "view")], schema)
    end.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = spark.read.schema(schema).parquet(str(tmp_path / "in"))

    def stream():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run(df, name):
        out = []
        aggregate.run_available(df, lambda b, _: out.extend(map(tuple, b.collect())), str(tmp_path / name))
        return sorted(out)

    keyed = batch.where("user < 99").withColumn("k", F.monotonically_increasing_id())
    own = sessions.gap_sessions(keyed, "user", "ts", "k", 60)
    want = own.groupBy("user", "session").agg(
        F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"), F.count_if(F.col("kind") == "click").alias("c")
    )
    got = run(aggregate.idle_sessions(stream(), "user", "ts", "kind", 60, "2 hours"), "idle")
    closed = [g for g in got if g[0] < 99]
    assert closed == sorted(map(tuple, want.drop("session").collect()))

    tumbled = run(aggregate.tumbling_counts(stream(), "ts", "kind", "5 seconds", "2 hours"), "tumble")
    wanted = sessions.tumbling(batch, ["kind"], "ts", 5).select("bucket", "kind", "n").where(F.col("bucket") < at(10**6 - 7300))
    assert tumbled == sorted(map(tuple, wanted.collect()))

    touched = run(aggregate.accepted_touches(stream(), "user", "ts", 600), "touch")
    assert len(touched) == 301 and any(t[2] for t in touched) and any(t[3] == "rate_limited" for t in touched)


def test_frame_duplicates(spark):
    from tidemark.operators import policy

    rows = [("a", at(0), 1), ("a", at(2), 1 << 40), ("a", at(4), 1), ("b", at(0), 1), ("b", at(11), 1)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, bits long")
    got = policy.frame_duplicates(df, "k", "ts", "bits", window_seconds=10, fraction=0.0)
    assert [r["duplicate"] for r in got.orderBy("k", "ts").collect()] == [False, False, True, False, False]
    images = [("a", at(n), 7, [float(x)] * 4) for n, x in enumerate((10, 12, 13, 40))]
    shown = spark.createDataFrame(images, "k string, ts timestamp, bits long, px array<double>")
    near = policy.frame_duplicates(shown, "k", "ts", "bits", "px")
    assert [r["duplicate"] for r in near.orderBy("ts").collect()] == [False, True, False, False]
    now = F.lit(at(48 * 3600))
    stale = policy.stale_split(df, now, 48, "ts").where("k = 'b'").orderBy("ts").collect()
    assert [r["stale"] for r in stale] == [False, False]
    assert policy.stale_split(df, F.lit(at(48 * 3600 + 1)), 48, "ts").where("stale").count() == 2
    assert policy.namespace_view(df, "a", "k").count() == 3


def test_common_passages_keep_their_candidates(spark, tmp_path):
    from tidemark.plans import audit_queries

    passage = "Shared words of a passage that many documents hold"
    docs = [(i, f"{passage} number{i}" if i < 30 else f"other text {i}") for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = audit_queries.eval_recall_mrr(spark, str(tmp_path)).first()
    assert got["n_queries"] == 1 and got["mrr"] == 1.0 and got["recall"] == pytest.approx(10 / 30, abs=1e-6)
    assert audit_queries.sensitivity_jaccard(spark, str(tmp_path)).first()["jaccard"] == 1.0


def test_conflicts_are_found_in_whole_texts(spark, tmp_path):
    from tidemark.plans import audit_queries

    far = "word " * 2000
    rows = [(1, f"{far} version 2.0"), (41, f"{far} version 3"), (2, "cost: $5"), (42, "Cost: $6,"), (82, None), (3, "cost 1,0 cost 10")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_chars": F.lit(1), "lang": F.lit("en")})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["pack"]: tuple(r)[1:] for r in audit_queries.conflict_detect(spark, str(tmp_path)).collect()}
    assert got == {1: ("version", True, False), 2: ("amount", True, False), 3: ("", False, False)}


def test_strategies_are_compared_on_whole_texts(spark, tmp_path):
    from tidemark.plans import policy_queries

    rows = [("The same beginning, one end", "en"), ("The same beginning, two end", "en"), ("the same", "de")]
    docs = spark.createDataFrame([(i, t, lang, len(t)) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r[0]: (r["pass_rate"], r["mean_tokens"]) for r in policy_queries.strategy_comparison(spark, str(tmp_path)).collect()}
    assert got == {"en": (0.5, 7.0), "de": (1.0, 2.0)}


def test_input_under_a_context_is_debounced(spark):
    rows = [
        (at(0), "input", "none"), (at(1), "foreground", "Editor"), (at(2), "input", "x"), (at(4), "input", "x"), (at(9), "input", "x"),
        (at(10), "foreground", " DENIED"), (at(11), "input", "x"), (at(12), "foreground", "Mail"), (at(13), "input", "x"), (at(14), "input", "x"),
    ]
    df = spark.createDataFrame([("u", n, *r) for n, r in enumerate(rows)], "u string, n int, ts timestamp, kind string, app string")
    out = sessions.input_activity(df, "u", "ts", "n", "kind", "app", ["denied"], 5)
    assert sorted((r["n"], r["app"]) for r in out.collect()) == [(1, "Editor"), (2, "Editor"), (4, "Editor"), (7, "Mail"), (8, "Mail")]


def test_input_buckets_flush(spark):
    rows = [
        (at(0), "keyboard", 0), (at(1), "keyboard", 0), (at(2), "mouse", 1), (at(3), "mouse", 0), (at(4), "foreground", 0),
        (at(5), "keyboard", 0), (at(16), "keyboard", 0), (at(17), "keyboard", 0), (at(80), "keyboard", 0),
    ]
    df = spark.createDataFrame([("u", n, *r) for n, r in enumerate(rows)], "u string, n int, ts timestamp, device string, mouse_left_clicks int")
    out = sessions.input_buckets(df, "u", "ts", "n", "device", 10, 60).orderBy("bucket")
    got = [(r["session"], r["n"], r["keyboard_events"], r["mouse_left_clicks"]) for r in out.collect()]
    # By a click; what a foreground row ends; by age; what is left when the session ends; the next session.
    assert got == [(0, 3, 2, 1), (0, 1, 0, 0), (0, 2, 2, 0), (0, 1, 1, 0), (1, 1, 1, 0)]


def test_micro_batches_by_time(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    query = aggregate.flush_by_size(stream, lambda batch, n: seen.extend(r[0] for r in batch.collect()), str(tmp_path / "state"), 0.1)
    query.processAllAvailable()
    query.stop()
    assert sorted(seen) == list(range(10))


def test_layout_as_markdown(spark):
    from tidemark.operators import documents

    words = [(0, 0, 10, 30, "Title"), (0, 40, 10, 50, "a"), (100, 40, 110, 50, "b"), (200, 40, 210, 50, "c"), (0, 60, 9, 70, "1)"), (12, 60, 20, 70, "one")]
    rows = spark.createDataFrame([(1, *map(float, w[:4]), w[4]) for w in words], "doc long, x0 double, y0 double, x1 double, y1 double, word string")
    lines = documents.layout_lines(rows, "doc")
    assert [r["kind"] for r in lines.orderBy("line").collect()] == ["heading", "table", "list"]
    assert documents.layout_markdown(lines, "doc").first()["markdown"] == "## Title\n| a | b | c |\n1) one"


def test_queues(spark):
    from tidemark.operators import queues

    schema = "job_key string, job_type string, status string, attempts int, max_attempts int, scheduled_for timestamp, created_at timestamp, lease_expires_at timestamp, leased_by string, last_error string"
    jobs = spark.createDataFrame([("a", "x", "pending", 0, 2, at(0), at(0), None, None, None), ("b", "x", "pending", 0, 2, at(9), at(0), None, None, None)], schema)
    new = spark.createDataFrame([("b", 1), ("c", 2), ("c", 3), ("d", 4), ("e", 5)], "job_key string, n int")
    assert sorted(r[0] for r in queues.enqueue(jobs, new, "job_key", "n", 4).select("job_key").collect()) == ["a", "b", "c", "d"]
    now = F.lit(at(5))
    leased = queues.lease(jobs, now, "w", 10)
    state = {r["job_key"]: (r["status"], r["attempts"]) for r in leased.collect()}
    assert state == {"a": ("leased", 1), "b": ("pending", 0)}  # b isn't due
    failed = queues.fail(leased, spark.createDataFrame([("a", "oops")], "job_key string, error string"), now, 30)
    row = failed.where("job_key = 'a'").first()
    assert (row["status"], row["last_error"], row["scheduled_for"]) == ("pending", "oops", at(35))
    late = queues.recover_stale(leased, F.lit(at(16)))
    assert {r["job_key"]: (r["status"], r["leased_by"]) for r in late.collect()} == {"a": ("pending", None), "b": ("pending", None)}


def test_keys_in_spans_give_the_same(spark):
    """Every order-dependent operator with keys cut into spans of different lengths against whole keys."""
    rng = random.Random(8)
    rows = [
        (u, n, at(rng.randrange(200_000)), rng.choice(["mail", "mail app", "editor"]), rng.choice(["a b", "c", None]))
        for u in ("x", "y") for n in range(300)
    ]
    df = spark.createDataFrame(rows, "u string, n int, ts timestamp, app string, title string")
    whole = lambda x: sorted(map(str, x.collect()))
    context = F.when(F.col("n") % 3 == 0, F.col("title"))
    calls = [
        lambda s: sessions.gap_sessions(df, "u", "ts", "n", 900, span_seconds=s),
        lambda s: sessions.threads(df, "u", "ts", "n", "app", "title", 10, span_seconds=s),
        lambda s: sessions.as_of_context(df, "u", "ts", "n", context, span_seconds=s).select("u", "n", "context"),
        lambda s: sessions.changes(df, "u", "ts", "n", "app", span_seconds=s),
    ]
    for call in calls:
        want = whole(call(None))
        for seconds in (60, 7000, 1e7):
            assert whole(call(seconds)) == want


def test_adapters_that_fail_when_their_rows_are_read(spark):
    good = spark.createDataFrame([("e1", 0.5, "x"), ("", 0.1, "no id"), ("e2", None, "y")], "event_id string, score double, snippet string")
    asked = []

    def late(query, most):
        asked.append(query)
        return good.withColumn("event_id", F.raise_error(F.lit("the source is gone")).cast("string"))

    def third(query, most):
        asked.append("third")
        return good if asked.count("third") == 3 else late(query, most)

    out = graph.adapters([("late", late, 5), ("good", lambda q, n: good, 1), ("third", third, 5)], "q", 10)
    rows = [tuple(r) for r in out.collect()]
    assert [r[3] for r in rows] == ["good", "third", "third"] and rows[2][1] == 0.0
    assert graph.adapters([("late", late, 5)], "q", 10) is None


def test_numbers_over_all_rows(spark):
    from tidemark.operators import ordered

    df = spark.range(500).select("id", (F.col("id") % 7).alias("s")).repartition(5)
    got = {r["id"]: r["rank"] for r in ordered.rank_over_all(df, "s", ties=["id"], rising=True).collect()}
    want = sorted(range(500), key=lambda i: (i % 7, i))
    assert got == {i: n for n, i in enumerate(want, 1)}
