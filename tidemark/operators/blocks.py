"""The best rows of many query vectors by products of blocks: no pair of a query and a row is ever a row of a table.

Rows and queries are packed into blocks. Each pair of blocks is one product of matrices, of which
only what can still be among a query's best k leaves the task: pairs whose product is within
TOLERANCE of the k-th. Those are scored once more, component after component as Spark's
expressions do, so results equal theirs to the last bit. Rows of one block with equal
vectors go in as k + 1 rows, those of the smallest keys.

Vectors with nulls, other lengths or components that aren't finite are *odd*; they are few and go pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import vectors
from tidemark.sources.tables import spread

#: Rows and queries of a block at most; queries whose best a task holds at a time.
BLOCK_ROWS, BLOCK_QUERIES, HELD_QUERIES = 2048, 256, 100_000
#: Query blocks are handed to all tasks up to so many bytes of vectors; more are met by a product of partitions.
HANDED_OUT_BYTES = 100_000_000
#: Scores are compared with six decimals; products further than this from the k-th can't share its place.
TOLERANCE = 1.1e-6


def regular(vector: Column, dim: int) -> Column:
    """Whether a vector has ``dim`` finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dim) & finite, F.lit(False))


def _packed(rows: DataFrame, key: str, vector: str, dim: int, most: int, by: str | None = None, mask: str | None = None) -> DataFrame:
    """Blocks ``(keys, data, by or mask)`` of rows as they lie in their partitions, each of one value of ``by``."""
    kind = rows.schema[key].dataType.simpleString()
    extra = by or mask

    def blocks(table: pa.Table) -> Iterator[pa.RecordBatch]:
        marks = np.asarray(table.column(2)) if by else np.zeros(table.num_rows, np.int64)
        for mark in np.unique(marks):
            at = np.flatnonzero(marks == mark)
            for low in range(0, len(at), most):
                part = table.take(pa.array(at[low : low + most])).combine_chunks()
                data = np.asarray(part.column(1).combine_chunks().flatten(), np.float64)
                keys = part.column(0).combine_chunks()
                columns = [pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([data.tobytes()], pa.binary())]
                if mask:
                    columns.append(pa.array([np.asarray(part.column(2).combine_chunks().flatten(), np.uint8).tobytes()], pa.binary()))
                elif by:
                    columns.append(pa.array([int(mark)], pa.int32()))
                yield pa.RecordBatch.from_arrays(columns, ["keys", "data", *([extra] if extra else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= (16 if by else 4) * most:
                yield from blocks(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from blocks(pa.Table.from_batches(held))

    schema = f"keys array<{kind}>, data binary" + (f", {extra} binary" if mask else f", {extra} int" if by else "")
    return rows.select(key, vector, *([extra] if extra else [])).mapInArrow(run, schema)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of paired rows, summed in order of components."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def _score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    both = np.sqrt(_dot(a, a)) * np.sqrt(_dot(b, b))
    dot = _dot(a, b)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(both > 0, dot / both, 0.0)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.where(norm > 0, norm, 1.0)[:, None]


def _first_of_equal(groups: list[np.ndarray], keys: np.ndarray, n: int) -> np.ndarray:
    """Places of rows that are among the n smallest keys of their group."""
    _, order_of = np.unique(keys, return_inverse=True)
    order = np.lexsort((order_of, *groups))
    new = np.ones(len(order), bool)
    new[1:] = np.any([g[order][1:] != g[order][:-1] for g in groups], axis=0)
    at = np.arange(len(order))
    return order[at - np.maximum.accumulate(np.where(new, at, 0)) < n]


def _with_keys(batch: pa.RecordBatch, name: str, i: int) -> np.ndarray:
    return np.asarray(batch.column(name)[i].values.to_numpy(zero_copy_only=False))


def _best_of_blocks(rows: DataFrame, queries: DataFrame, k: int, dim: int, kinds: tuple[str, str], masked: bool, few: bool) -> DataFrame:
    """``(query, key, score)`` that hold each query's best k, from packed blocks; the score isn't rounded."""
    right = queries.select(F.monotonically_increasing_id().alias("q_block"), F.col("keys").alias("q_keys"), F.col("data").alias("q_data"), *(["mask"] if masked else []))
    right = right.hint("broadcast") if few else right
    pairs = rows.withColumn("block", F.monotonically_increasing_id()).crossJoin(right)  # of blocks: a stated query set against all rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}  # by query block: its keys, vectors, k best products, and found (query place, key, score)
        held, last = 0, None

        def give() -> Iterator[pa.RecordBatch]:
            for q_keys, _, _, least, found in best.values():
                if found:
                    at, keys, scores = (np.concatenate(x) for x in zip(*found))
                    keep = scores >= least[at] - TOLERANCE
                    at, keys, scores = at[keep], keys[keep], scores[keep]
                    keep = _first_of_equal([scores, at], keys, k)
                    yield pa.RecordBatch.from_arrays([pa.array(q_keys[at[keep]]), pa.array(keys[keep]), pa.array(scores[keep])], ["query", "key", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                block, mark = (batch.column(c)[i].as_py() for c in ("block", "q_block"))
                if block != last:  # the pairs of one block of rows follow each other
                    last, x, keys = block, np.frombuffer(batch.column("data")[i].as_py()).reshape(-1, dim), _with_keys(batch, "keys", i)
                    _, same = np.unique(x.view(np.dtype((np.void, 8 * dim))).ravel(), return_inverse=True)
                    own = np.sort(_first_of_equal([same.ravel()], keys, k + 1))
                    x, keys = x[own], keys[own]
                    unit = _unit(x)
                if mark not in best:
                    if held > HELD_QUERIES:
                        yield from give()
                        best, held = {}, 0
                    q = np.frombuffer(batch.column("q_data")[i].as_py()).reshape(-1, dim)
                    best[mark] = (_with_keys(batch, "q_keys", i), q, _unit(q), np.full(len(q), -np.inf), [])
                    held += len(q)
                q_keys, q, q_unit, least, found = best[mark]
                if masked:
                    bits = np.frombuffer(batch.column("mask")[i].as_py(), np.uint8).reshape(len(q), -1)
                    wanted = np.flatnonzero(bits[:, batch.column("bucket")[i].as_py()])
                else:
                    wanted = np.arange(len(q))
                if not len(wanted):
                    continue
                product = q_unit[wanted] @ unit.T
                hit = product >= least[wanted][:, None] - 2 * TOLERANCE
                some = np.flatnonzero(hit.any(axis=1))
                if not len(some):
                    continue
                if product.shape[1] > k + 1:  # one may be the query's own row
                    top = np.partition(product[some], product.shape[1] - k - 1, axis=1)[:, -k - 1]
                    floor = np.maximum(least[wanted[some]], top)
                else:
                    floor = least[wanted[some]]
                a, b = np.nonzero(product[some] >= floor[:, None] - 2 * TOLERANCE)
                a = wanted[some[a]]
                keep = q_keys[a] != keys[b]
                a, b = a[keep], b[keep]
                found.append((a, keys[b], _score(q[a], x[b])))
                if sum(len(f[0]) for f in found) > 8 * k * len(q) or len(found) == 1:
                    at, names, scores = (np.concatenate(f) for f in zip(*found))
                    order = np.lexsort((-scores, at))
                    at, names, scores = at[order], names[order], scores[order]
                    begin = np.searchsorted(at, np.arange(len(q)))
                    full = np.searchsorted(at, np.arange(len(q)), "right") - begin >= k
                    least[full] = scores[begin[full] + k - 1]
                    keep = scores >= least[at] - TOLERANCE
                    at, names, scores = at[keep], names[keep], scores[keep]
                    keep = _first_of_equal([scores, at], names, k)
                    found[:] = [(at[keep], names[keep], scores[keep])]
        yield from give()

    return pairs.mapInArrow(run, f"query {kinds[0]}, key {kinds[1]}, score double")


def best(
    rows: DataFrame, queries: DataFrame, k: int, key: str, vector: str, dim: int, bucket: str | None = None, mask: str | None = None
) -> DataFrame:
    """``(query, key, score, rank)``: each query's k best rows by rounded cosine, ties to the smaller key; never a row of its own key.

    ``queries`` has ``(query, q)``, q of ``dim`` doubles, and in ``mask`` an array with 1 for each ``bucket`` it looks into.
    """
    key_kind, query_kind = rows.schema[key].dataType.simpleString(), queries.schema["query"].dataType.simpleString()
    rows, queries = rows.where(F.col(key).isNotNull()), queries.where(F.col("query").isNotNull())
    plain, odd = (rows.where(x) for x in (regular(F.col(vector), dim), ~regular(F.col(vector), dim)))
    q_plain, q_odd = (queries.where(x) for x in (regular(F.col("q"), dim), ~regular(F.col("q"), dim)))
    few = q_plain.count() * dim * 8 <= HANDED_OUT_BYTES
    own = _packed(q_plain.coalesce(8), "query", "q", dim, BLOCK_QUERIES, mask=mask)  # few tasks, so that blocks are full
    every = _best_of_blocks(_packed(spread(plain), key, vector, dim, BLOCK_ROWS, by=bucket), own, k, dim, (query_kind, key_kind), mask is not None, few)

    def pair_by_pair(of: DataFrame, among: DataFrame) -> DataFrame:
        on = F.col("query") != F.col(key)
        on = on if mask is None else on & (F.get(F.col(mask), F.col(bucket)) == 1)
        return of.join(among, on).select("query", F.col(key).alias("key"), vectors.cosine(F.col(vector), F.col("q")).alias("score"))

    if not q_odd.isEmpty():
        every = every.unionByName(pair_by_pair(q_odd, rows))
    if not odd.isEmpty():
        every = every.unionByName(pair_by_pair(q_plain, odd))
    order = Window.partitionBy("query").orderBy(F.desc("score"), key)
    rounded = every.select("query", F.col("key").alias(key), F.round("score", 6).alias("score"))
    return rounded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
