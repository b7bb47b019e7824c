"""Folds in order: decisions that hang on the decision before, key by key, in bounded memory."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def fold_in_order(
    rows: DataFrame, by: Sequence[str], order: Sequence[str], step: Callable, name: str, kind: str, start=None,
    uses: Sequence[str] | None = None,
) -> DataFrame:
    """rows with a column ``name`` that ``step(state, key, row) -> (state, value)`` gives in order.

    ``uses`` names the columns that the step looks at; the others pass through as they are.

    The state begins as ``start`` at each key. Rows are dealt out by key, sorted within
    the task, and go through as a stream of Arrow batches with the state carried
    from one to the next: no key is ever held as a whole, however large.
    """
    sorted_rows = rows.repartition(*by).sortWithinPartitions(*by, *order)
    names = rows.columns
    keys = list(by)
    wanted = list(dict.fromkeys([*by, *(names if uses is None else uses)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state = None, start
        for batch in batches:
            columns = [batch.column(names.index(c)).to_pylist() for c in wanted]
            out = []
            for values in zip(*columns):
                own = values[: len(keys)]
                if own != group:
                    group, state = own, start
                state, value = step(state, own, dict(zip(wanted, values)))
                out.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, _TYPES[kind])], [*batch.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return sorted_rows.mapInArrow(run, f"{schema}, `{name}` {kind}")


# --- limits of rate, with keys cut into spans of time ------------------------------------------


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of each key (the first n_keys columns) of sorted batches."""
    group, held = None, []
    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(n_keys))))
        begin = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[begin]:
                if held and keys[begin] != group:
                    yield group, pa.Table.from_batches(held)
                    held = []
                group = keys[begin]
                held.append(batch.slice(begin, i - begin))
                begin = i
    if held:
        yield group, pa.Table.from_batches(held)


def _last_of_chains(times: np.ndarray, limit: int, upto: int) -> np.ndarray:
    """The time of the last accepted row of the chains that begin at rows 0 to upto, by pointers of 1, 2, 4, ... steps."""
    n = len(times)
    step = np.append(np.searchsorted(times, times + limit, "left"), n)  # n stands for none
    jumps = [step]
    while (jumps[-1][: upto + 1] < n).any():
        jumps.append(jumps[-1][jumps[-1]])
    at = np.arange(upto + 1)
    for jump in reversed(jumps):
        further = jump[at]
        at = np.where(further < n, further, at)
    return times[at]


def spaced(rows: DataFrame, by: Sequence[str], ts: str, key: str, seconds: float, span_seconds: float, name: str) -> DataFrame:
    """rows with whether each is at least ``seconds`` after the last accepted one of its key, in the order of ts and key.

    A key is cut into spans of time, which tasks go through side by side. What a span does depends on the
    last accepted time before it only, and it is one of few answers: a first pass makes of each span a map from
    that time to its own last accepted one; maps are applied one after another (a small row for each span);
    a second pass marks the rows. A task holds the times of one span.
    """
    limit, width = round(seconds * 1e6), round(span_seconds * 1e6)
    names, keys = rows.columns, [f"_k{i}" for i in range(len(by))]
    dealt = rows.withColumns({"_t": F.unix_micros(ts), **{k: F.col(b) for k, b in zip(keys, by)}})
    dealt = dealt.withColumn("_span", F.floor(F.col("_t") / width).cast("long"))
    kinds = ", ".join(f"{k} {rows.schema[b].dataType.simpleString()}" for k, b in zip(keys, by))
    types = [to_arrow_type(rows.schema[b].dataType) for b in by]

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, table in _runs(batches, len(keys) + 1):
            times = table.column("_t").to_numpy()
            # The chain begins less than the limit after the span's own beginning, or with its first row.
            upto = min(int(np.searchsorted(times, group[-1] * width + limit, "left")), len(times) - 1)
            last = _last_of_chains(times, limit, upto)
            ends = np.append(np.flatnonzero(last[1:] != last[:-1]), upto)
            values = [pa.array([v], t) for v, t in zip(group, [*types, pa.int64()])]
            lists = [pa.array([x[ends].tolist()], pa.list_(pa.int64())) for x in (times, last)]
            yield pa.RecordBatch.from_arrays([*values, *lists], [*keys, "_span", "begins", "lasts"])

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, None
        for batch in batches:
            out = []
            columns = [c.to_pylist() for c in batch.columns]
            for *own, _, begins, lasts in zip(*columns):
                if own != group:
                    group, held = own, None
                out.append(held)
                i = 0 if held is None else bisect.bisect_left(begins, held + limit)
                held = lasts[i] if i < len(begins) else held
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys) + 1], pa.array(out, pa.int64())], [*keys, "_span", "_held"])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in _runs(batches, len(keys) + 1):
            times, held = table.column("_t").to_numpy(), table.column("_held")[0].as_py()
            accepted = np.zeros(len(times), bool)
            at = 0 if held is None else int(np.searchsorted(times, held + limit, "left"))
            while at < len(times):
                accepted[at] = True
                at = int(np.searchsorted(times, times[at] + limit, "left"))
            out = table.select(names).append_column(name, pa.array(accepted))
            yield from out.to_batches(max_chunksize=50_000)

    order = [*keys, "_span"]
    known = dealt.where(F.col("_t").isNotNull())
    each = known.select(*order, "_t").repartition(*order).sortWithinPartitions(*order, "_t")
    summaries = each.mapInArrow(maps, f"{kinds}, _span long, begins array<long>, lasts array<long>")
    before = summaries.repartition(*keys).sortWithinPartitions(*order).mapInArrow(applied, f"{kinds}, _span long, _held long")
    same = [dealt[k].eqNullSafe(before[k]) for k in keys]
    joined = known.join(before, [*same, known["_span"] == before["_span"]]).select(*(known[c] for c in known.columns), before["_held"])
    ready = joined.select(*order, *rows.columns, "_t", "_held").repartition(*order).sortWithinPartitions(*order, "_t", key)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return ready.mapInArrow(marked, f"{schema}, `{name}` boolean")


_TYPES = {"boolean": pa.bool_(), "string": pa.string(), "long": pa.int64(), "double": pa.float64()}


def packed(rows: DataFrame, *columns: str):
    """Columns of rows as one struct, for results that travel beside a fold."""
    return F.struct(*(rows[c] for c in columns))
