"""State with expiry against a plain loop, over several micro-batches."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from tidemark.operators.memory import HALF_LIVES, WEIGHTS
from tidemark.streaming import aggregate, stateful

T0 = 1_700_000_000


def plain(touches, seconds, ttl):
    held, out = {}, []
    for k, at in touches:
        last, kept, sums = held.get(k, (None, None, [0.0] * 4))
        if last is not None and at >= last + ttl:
            last, kept, sums = None, None, [0.0] * 4
        ok = (last is None or at >= last) and (kept is None or at - kept >= seconds)
        if ok:
            sums = [s * 0.5 ** ((at - (at if kept is None else kept)) / h) + 1 for s, h in zip(sums, HALF_LIVES.values())]
            kept = at
        held[k] = (at if last is None else max(last, at), kept, sums)
        out.append((k, at, ok, sum(w * s for w, s in zip(WEIGHTS.values(), sums))))
    return out


def test_stream_equals_the_loop_and_state_ends(spark, tmp_path):
    rng = random.Random(4)
    batches, start = [], T0
    for n in range(4):
        batches.append([(k, start + rng.randrange(3000)) for k in rng.choices("abcd" if n < 2 else "ab", k=60)])
        start += 20_000
    schema, rows = "u string, ts timestamp", []
    for n, batch in enumerate(batches):
        stamped = [(k, dt.datetime.fromtimestamp(t, dt.timezone.utc)) for k, t in batch]
        spark.createDataFrame(stamped, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p={n}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / f"p=[0-{n}]"))
        out = stateful.decaying_touches(stream, "u", "ts", 60, 15_000)
        aggregate.run_available(out, lambda b, i: rows.extend(map(tuple, b.collect())), str(tmp_path / "state"))
    want = sorted(x for x in plain([x for b in batches for x in sorted(b)], 60, 15_000))
    got = sorted((u, at, ok, score) for u, at, ok, _, score in rows)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])
    state = spark.read.format("statestore").option("stateVarName", "touches").load(str(tmp_path / "state"))
    keys = {r["key"][0] for r in state.select("key").collect()}
    assert "c" not in keys and "d" not in keys and keys <= {"a", "b"}
