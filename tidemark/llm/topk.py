"""Exact top-k inner-product search with a pivot-distance index.

Vectors hold integers, ``floor(scale * x)``. Since
``q.v = (|q|^2 + |v|^2 - |q - v|^2) / 2``, a lower bound on distances and an upper
one on norms bound products from above.

*Index.* Pivots come from a bounded sample (farthest-first), and every vector
is keyed by its nearest pivot and its distance to it: a pivot's distances are
cut into annuli at quantiles of the sample. Pivots and annuli become more as the
table grows, up to ``MOST_PIVOTS`` and ``MOST_RINGS``. An annulus keeps its
least and greatest distance to its own pivot and to ``REFERENCES`` others, and
is stored in blocks of a bounded number of vectors.

*Search.* By the triangle inequality an annulus whose distances to a pivot p are
within [lo, hi] only holds v with ``d(q, v) >= max(lo - d(q, p), d(q, p) - hi)``,
and ``q.v <= q.p + |q| d(v, p)``. The least of the bounds that these give for the
pivots and the annulus's largest norm counts. A query sorts all annuli by that
bound and expands: it opens the first one, then 4, 16, ... more. After each round
its k-th best product has risen, and it stops at the first annulus whose bound is
below it. Ties stay, so the result is exact. Queries that open the same annulus
go in blocks, and one product of matrices serves a block of queries and a block
of vectors.

Products are exact: in double precision where they stay below 2**53, else from
21-bit limbs. Components saturate at +-2**62 and scores at the bounds of a long;
ranks follow the saturated score.

Equal vectors are one entry that keeps its ``k + 1`` smallest ids, which is all
that any query can take of them, so a vector that is very common costs as much
as one.

Edge cases: a null vector, or one with a null or non-finite component, takes no
part; vectors are compared with those of their own length only; a null id takes
no part; fewer than k candidates give fewer rows; an empty table gives an
empty table; rows that repeat an id and a vector count once; other columns are
not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, session_of

#: Pivots and annuli of a pivot at most, vectors that they are fitted on, vectors in a block.
MOST_PIVOTS, MOST_RINGS, SAMPLE, BLOCK = 256, 64, 4096, 1024
#: Pivots to which an annulus keeps its distances, besides its own.
REFERENCES = 24
#: Annuli that a query opens in the first round, and how many times more in each next one.
FIRST_OPEN, OPEN_TIMES = 1, 4
#: Components are held within these bounds.
_LARGEST = 1 << 62
_NOTHING = np.empty(0, np.int64)


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component as long, within +-2**62."""
    bound = F.lit(float(_LARGEST))
    return F.transform(
        vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, bound), -bound)).cast("long")
    )


def usable(vector: Column) -> Column:
    """Whether a vector has components and all of them are finite numbers."""
    whole = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")),
    )
    return F.coalesce(whole & (F.size(vector) > 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column as whole numbers, a row for each list."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def products(qs: np.ndarray, vs: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer matrices, saturated at the bounds of a long."""
    most = float(np.abs(qs.astype(float)).max(initial=0)) * float(np.abs(vs.astype(float)).max(initial=0))
    if most * qs.shape[1] < 2**53:
        return np.rint(qs.astype(float) @ vs.T.astype(float)).astype(np.int64)
    # Limbs of 21 bits: every sum of up to 1024 products of two limbs is exact in double precision.
    limbs = [[x & (2**21 - 1), (x >> 21) & (2**21 - 1), x >> 42] for x in (qs, vs)]
    sums = np.zeros((5, len(qs), len(vs)), np.int64)
    for at in range(0, qs.shape[1], 1024):
        cut = slice(at, at + 1024)
        for i, a in enumerate(limbs[0]):
            for j, b in enumerate(limbs[1]):
                sums[i + j] += np.rint(a[:, cut].astype(float) @ b[:, cut].T.astype(float)).astype(np.int64)
    for k in range(4):  # carry upwards, so that all but the last limb are within 21 bits
        sums[k + 1] += sums[k] >> 21
        sums[k] &= 2**21 - 1
    low = sums[0] | sums[1] << 21 | sums[2] << 42
    inside = ((sums[4] == 0) & (sums[3] == 0)) | ((sums[4] == -1) & (sums[3] == 2**21 - 1))
    negative = sums[4] < 0
    low = np.where(negative, low + np.int64(-(2**63)), low)
    return np.where(inside, low, np.where(negative, np.int64(-(2**63)), np.int64(2**63 - 1)))


def fit(sample: np.ndarray, pivots: int, rings: int) -> tuple[np.ndarray, np.ndarray]:
    """(pivots, cuts): farthest-first pivots of a sample, and each one's ring boundaries.

    Cuts are quantiles of the sample's distances, so rings hold about equally many.
    """
    chosen = [int(np.argmax(((sample - sample.mean(axis=0)) ** 2).sum(axis=1)))]
    near = ((sample - sample[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(pivots, len(sample)) and near.max() > 0:
        chosen.append(int(np.argmax(near)))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    at = sample[chosen]
    for _ in range(4):  # centre the pivots on what is nearest to them
        own = distances(sample, at).argmin(axis=1)
        at = np.stack([sample[own == p].mean(axis=0) if (own == p).any() else at[p] for p in range(len(at))])
    far = distances(sample, at)
    own, least = far.argmin(axis=1), far.min(axis=1)
    levels = np.linspace(0, 1, rings + 1)[1:-1]
    everywhere = np.quantile(least, levels)
    cuts = np.stack(
        [np.quantile(least[own == p], levels) if (own == p).any() else everywhere for p in range(len(at))]
    )
    return at, cuts


def distances(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to pivots."""
    squared = (rows**2).sum(axis=1)[:, None] + (at**2).sum(axis=1)[None, :] - 2 * rows @ at.T
    return np.sqrt(np.maximum(squared, 0))


class Directory:
    """The annuli of an index: their sizes, largest norms and distances to pivots. Bounded."""

    def __init__(self, rows: list, at: np.ndarray, refs: int):
        self.at, self.refs = at, refs
        self.cells = np.array([r["cell"] for r in rows], np.int64)
        self.sizes = np.array([r["n"] for r in rows], np.int64)
        self.top = np.array([r["top"] for r in rows])
        self.low, self.high = (np.array([[r[f"{s}{i}"] for i in range(refs + 1)] for r in rows]) for s in ("lo", "hi"))

    def bounds(self, qs: np.ndarray, rings: int) -> np.ndarray:
        """For each query an upper bound on its products with every annulus."""
        qs = qs.astype(float)
        far = distances(qs, self.at)
        own = far[:, self.cells // rings]
        gap = np.maximum(self.low[None, :, 0] - own, own - self.high[None, :, 0])
        for i in range(self.refs):
            to = far[:, i][:, None]
            gap = np.maximum(gap, np.maximum(self.low[None, :, i + 1] - to, to - self.high[None, :, i + 1]))
        squared = (qs**2).sum(axis=1)[:, None]
        both = squared + self.top[None, :]
        # Slack for rounding: distances carry an error of some 1e-7 of the norms at most.
        gap = np.maximum(gap - 1e-6 * np.sqrt(both), 0)
        reach = self.high[None, :, 0] + 1e-6 * np.sqrt(both)
        near = (qs @ self.at.T)[:, self.cells // rings] + np.sqrt(squared) * reach
        return np.minimum((both - gap**2) / 2, near) + 1e-9 * both + 0.5


def exact_top_k(
    vectors: DataFrame,
    k: int = 5,
    every: int = 50,
    scale: int = 256,
    key: str = "vec_id",
    vector: str = "embedding",
    sample: int = SAMPLE,
    block: int = BLOCK,
    work: dict | None = None,
) -> DataFrame:
    """``(query_id, rank, key, score)``: the k best candidates of every id divisible by ``every``.

    The score is the inner product of quantised vectors; ties go to the smaller
    id; a query is no candidate of its own. ``work`` gets the numbers of pairs
    of a query and an entry that were multiplied (``pairs``) and that there are (``all``).
    """
    spark = session_of(vectors)
    rows = (
        vectors.where(F.col(key).isNotNull() & usable(F.col(vector)))
        .select(F.col(key).cast("long").alias("id"), quantised(F.col(vector), scale).alias("v"))
        .withColumn("dim", F.size("v"))
        .distinct()
    )
    # Equal vectors become one entry with its k + 1 least ids. The rank limit works within every
    # task before the shuffle, so a very common vector is never gathered in one place.
    same = Window.partitionBy("dim", "v").orderBy("id")
    least = rows.withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1)
    entries = materialise(
        least.groupBy("dim", "v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    )
    queries = materialise(rows.where(F.col("id") % every == 0).select("id", "v", "dim"))

    parts = []
    for dim in sorted(r[0] for r in entries.select("dim").distinct().collect()):
        own = [x.where(F.col("dim") == dim).drop("dim") for x in (entries, queries)]
        parts.append(_search(*own, k, sample, block, work))
    discard(entries, queries)
    if not parts:
        return spark.createDataFrame([], f"query_id long, rank int, {key} long, score long")
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    return found.select("query_id", "rank", F.col("cand").alias(key), "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query with their rank; cut within every task before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "cand")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(
    entries: DataFrame, queries: DataFrame, k: int, sample: int, block: int, work: dict | None
) -> DataFrame:
    """``(query_id, cand, score, rank)``: the k best of each query, by rounds of expansion."""
    n = entries.count()
    pivots = min(MOST_PIVOTS, max(8, int(math.sqrt(n) / 4)))
    rings = min(MOST_RINGS, max(4, n // (pivots * block)))
    taken = entries.orderBy(F.xxhash64("v"), "v").select("v").limit(sample).collect()
    at, cuts = fit(np.array([r[0] for r in taken], float), pivots, rings)
    refs = min(REFERENCES, len(at))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every vector's annulus."""
        for batch in batches:
            if not batch.num_rows:
                continue
            far = distances(_matrix(batch.column(0)).astype(float), at)
            pivot = far.argmin(axis=1)
            own = far[np.arange(len(pivot)), pivot]
            ring = (own[:, None] >= cuts[pivot]).sum(axis=1)
            cell = (pivot * rings + ring).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["v", "ids", "cell"])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each batch and annulus: vectors, largest squared norm, distances to the pivots."""
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch.column(0)).astype(float)
            cell, far = np.asarray(batch.column(1)), distances(rows, at)
            far = np.concatenate([far[np.arange(len(cell)), cell // rings][:, None], far[:, :refs]], axis=1)
            order = np.argsort(cell, kind="stable")
            found, first = np.unique(cell[order], return_index=True)
            low, high = (f.reduceat(far[order], first, axis=0) for f in (np.minimum, np.maximum))
            top = np.maximum.reduceat((rows**2).sum(axis=1)[order], first)
            count = np.diff(first, append=len(cell))
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.astype(np.int32)), pa.array(count.astype(np.int64)), pa.array(top)]
                + [pa.array(np.ascontiguousarray(x)) for m in (low, high) for x in m.T],
                ["cell", "n", "top", *(f"{s}{i}" for s in ("lo", "hi") for i in range(refs + 1))],
            )

    index = materialise(
        entries.select("v", "ids").mapInArrow(keyed, "v array<long>, ids array<long>, cell int")
    )
    ends = [(s, f, i) for s, f in (("lo", F.min), ("hi", F.max)) for i in range(refs + 1)]
    schema = ", ".join(["cell int, n long, top double", *(f"{s}{i} double" for s, _, i in ends)])
    # One row for each annulus: at most MOST_PIVOTS * MOST_RINGS.
    directory = Directory(
        index.select("v", "cell")
        .mapInArrow(measured, schema)
        .groupBy("cell")
        .agg(F.sum("n").alias("n"), F.max("top").alias("top"), *(f(f"{s}{i}").alias(f"{s}{i}") for s, f, i in ends))
        .collect(),
        at,
        refs,
    )
    blocks = [(int(c), max(1, -(-int(x) // block))) for c, x in zip(directory.cells, directory.sizes)]
    sizes = index.sparkSession.createDataFrame(blocks, "cell int, blocks long")
    packed = materialise(
        index.join(F.broadcast(sizes), "cell")
        .withColumn("part", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
        .groupBy("cell", "part")
        .agg(F.collect_list("v").alias("vs"), F.collect_list("ids").alias("ids"))
    )
    discard(index)
    if work is not None:
        work["all"] = work.get("all", 0) + n * queries.count()

    def opening(first: int, upto: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """For some queries every annulus from the first-th to before the upto-th that they must open."""
            for batch in batches:
                if not batch.num_rows:
                    continue
                qids, qs = np.asarray(batch.column(0)), _matrix(batch.column(1))
                beats = np.asarray(batch.column(2))
                bound = directory.bounds(qs, rings)
                order = np.argsort(-bound, axis=1, kind="stable")[:, first:upto]
                must = np.zeros(bound.shape, bool)
                reach = np.take_along_axis(bound, order, axis=1) >= beats[:, None]
                np.put_along_axis(must, order, reach, axis=1)
                for c in np.flatnonzero(must.any(axis=0)):
                    own = np.flatnonzero(must[:, c])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([int(directory.cells[c])], pa.int32()),
                            pa.array([int(directory.sizes[c]) * len(own)], pa.int64()),
                            _one_list(pa.array(qids[own])),
                            _one_list(_lists(qs[own])),
                            _one_list(pa.array(beats[own])),
                        ],
                        ["cell", "pairs", "qids", "qs", "beats"],
                    )

        return run

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                pivot = distances(_matrix(batch.column(1)).astype(float), at).argmin(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot)], ["id", "v", "pivot"])

    near = queries.select("id", "v").mapInArrow(nearest, "id long, v array<long>, pivot int")
    queries, best, first, step = materialise(near), None, 0, FIRST_OPEN
    wanted = "cell int, pairs long, qids array<long>, qs array<array<long>>, beats array<long>"
    while first < len(directory.cells):
        state = queries.withColumn("beat", F.lit(None).cast("long"))
        if best is not None:
            kth = best.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("beat"))
            state = queries.join(kth, "id", "left")
        # Queries of one pivot want the same annuli, so they go side by side.
        state = state.sortWithinPartitions("pivot").select("id", "v", F.coalesce("beat", F.lit(-(1 << 63))))
        wants = materialise(state.mapInArrow(opening(first, first + step), wanted))
        pairs = wants.agg(F.sum("pairs")).first()[0]
        if not pairs:
            discard(wants)
            break
        if work is not None:
            work["pairs"] = work.get("pairs", 0) + pairs
        met = wants.drop("pairs").join(packed, "cell").select("qids", "qs", "beats", "ids", "vs")
        found = met.mapInArrow(lambda b: _compare(b, k), "query_id long, cand long, score long")
        if best is not None:
            found = found.union(best.drop("rank"))
        after = materialise(_best(found, k))
        discard(wants, best)
        best, first, step = after, first + step, step * OPEN_TIMES
    discard(packed, queries)
    if best is None:
        spark = entries.sparkSession
        return spark.createDataFrame([], "query_id long, cand long, score long, rank int")
    return best


def _lists(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(rows).reshape(-1)))


def _one_list(values: pa.Array) -> pa.Array:
    """All values as the only list of a column."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _compare(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Best k of a block of vectors for each query of a block that reach what it has to beat."""
    for batch in batches:
        for i in range(batch.num_rows):
            qids = np.asarray(batch.column(0)[i].values)
            beat = np.asarray(batch.column(2)[i].values)
            lists = batch.column(3)[i].values
            scores = products(_matrix(batch.column(1)[i].values), _matrix(batch.column(4)[i].values))
            ids = np.asarray(lists.flatten())
            ends = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            out: list[list[np.ndarray]] = [[], [], []]
            width = min(k + 1, scores.shape[1])
            for q in range(len(qids)):
                own = scores[q]
                # The k + 1 best entries hold the k best candidates besides the query itself.
                floor = max(beat[q], np.partition(own, -width)[-width])
                some = np.flatnonzero(own >= floor)
                if not len(some):
                    continue
                cand = np.concatenate([ids[ends[s] : ends[s + 1]] for s in some])
                score = np.repeat(own[some], ends[some + 1] - ends[some])
                keep = cand != qids[q]
                cand, score = cand[keep], score[keep]
                best = np.lexsort((cand, ~score))[:k]
                out[0].append(np.full(len(best), qids[q]))
                out[1].append(cand[best])
                out[2].append(score[best])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([_NOTHING, *x])) for x in out], ["query_id", "cand", "score"]
            )
