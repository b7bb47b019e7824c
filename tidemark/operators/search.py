"""Vector, sparse and hybrid search; fusion, ranks, thresholds and reranking."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scoring, vectors
from tidemark.operators import blocks


def knn(rows: DataFrame, query: Sequence[float], k: int, key: str, vector: str, where: Column | None = None) -> DataFrame:
    """``(key, score)``: the k rows of highest cosine; exact, by a scan and a partial top-k in every task."""
    rows = rows if where is None else rows.where(where)
    score = F.round(vectors.cosine(F.col(vector), vectors.literal(query)), 6)
    return rows.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(k)


def candidate_cap(k: int, k_filtered: bool = False) -> int:
    """How many candidates an index scores for k results: 20 for each, 200 to 5000; with filters k, 50 at least (fixed values)."""
    return max(k, 100, 50) if k_filtered else min(max(20 * k, 200), 5000)


def lsh_index(rows: DataFrame, key: str, vector: str, dim: int, bits: int = 63, bucket_bits: int = 16) -> DataFrame:
    """``(key, vector, norm, signature, bucket)``; written partitioned by bucket, a search reads one bucket."""
    planes = vectors.hyperplanes(dim, bits)
    signed = rows.select(
        key, vector, vectors.norm(F.col(vector)).alias("norm"),
        vectors.lsh_signature(F.col(vector), planes).alias("signature"),
    )
    return signed.withColumn("bucket", vectors.lsh_bucket(F.col("signature"), bucket_bits))


def python_signature(query: Sequence[float], planes: Sequence[Sequence[float]]) -> int:
    """Signature of one query vector on the driver."""
    out = 0
    for i, plane in enumerate(planes):
        out |= (sum(a * b for a, b in zip(query, plane)) >= 0) << i
    return out


def lsh_knn(
    index: DataFrame, query: Sequence[float], k: int, key: str, vector: str, bits: int = 63, bucket_bits: int = 16,
    cap: int | None = None,
) -> DataFrame:
    """kNN within the query's bucket; if that holds fewer than k rows, over all rows instead.

    ``cap`` limits candidates by id before scoring, as an index with such a limit
    does; None scores all. The bucket's rows are counted first (k of them at most),
    so that only one of the two is read: with an index that is written partitioned by
    bucket that is one folder.
    """
    planes = vectors.hyperplanes(len(query), bits)
    bucket = python_signature(query, planes) & ((1 << bucket_bits) - 1)
    score = F.round(vectors.cosine(F.col(vector), vectors.literal(query)), 6).alias("score")

    def best(rows: DataFrame) -> DataFrame:
        rows = rows if cap is None else rows.orderBy(key).limit(cap)
        return rows.select(key, score).orderBy(F.desc("score"), key).limit(k)

    near = index.where(F.col("bucket") == bucket)
    return best(near if near.limit(k).count() >= k else index)


# --- several buckets of a stored index ---------------------------------------------------------


def write_lsh(
    rows: DataFrame, path: str, key: str, vector: str, dim: int, bits: int = 8, meta: Sequence[str] = (), held: Sequence[str] = ()
) -> None:
    """Store vectors in folders by bucket of ``bits`` planes, and the columns ``meta`` in a table of their own.

    ``held`` columns stay beside the vectors, such as the arrays that a mean vector stands for.
    """
    planes = vectors.hyperplanes(dim, bits)
    signed = rows.select(key, vector, *held, vectors.lsh_signature(F.col(vector), planes).cast("int").alias("bucket"))
    signed.repartition("bucket", F.pmod(F.xxhash64(key), F.lit(8))).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/vectors")
    rows.select(key, *meta).write.mode("overwrite").parquet(f"{path}/meta")


def probes(queries: DataFrame, vector: str, dim: int, bits: int, n: int | None = None) -> DataFrame:
    """queries with ``(bucket, probe)``: the buckets in the order in which each query looks into them, n or all.

    A bucket on the other side of some planes is as far as the squares of the query's distances from
    those planes add up to, so the nearest buckets come first; ties go to the lower bucket difference.
    """
    planes = F.array(*(vectors.literal(p) for p in vectors.hyperplanes(dim, bits)))
    margin = F.transform(planes, lambda p: F.round(vectors.dot(F.col(vector), p), 6))
    own = vectors.lsh_signature(F.col(vector), vectors.hyperplanes(dim, bits)).cast("int")
    placed = queries.withColumn("_margin", margin).withColumn("_own", own)
    flipped = lambda mask: F.aggregate(
        F.transform("_margin", lambda m, i: F.when(F.get(F.array(*(mask.bitwiseAND(1 << b) != 0 for b in range(bits))), i), m * m).otherwise(0.0)),
        F.lit(0.0),
        lambda s, x: s + x,
    )
    masks = F.sequence(F.lit(0), F.lit((1 << bits) - 1))
    ordered = F.array_sort(F.transform(masks, lambda m: F.struct(F.round(flipped(m), 6).alias("cost"), m.alias("mask"))))
    some = ordered if n is None else F.slice(ordered, 1, n)
    each = placed.select(*queries.columns, "_own", F.posexplode(some).alias("_at", "_p"))
    return each.select(*queries.columns, F.col("_own").bitwiseXOR(F.col("_p.mask")).alias("bucket"), (F.col("_at") + 1).alias("probe"))


def probe_candidates(spark, path: str, queries: DataFrame, key: str, vector: str, dim: int, bits: int, n: int | None, keys: DataFrame | None = None) -> DataFrame:
    """``(query, the index's columns, score)``: rows of the probed buckets with their cosine, of ``(query, q)`` rows.

    Only folders of probed buckets are read. ``keys`` are those that a filter on the table of meta rows leaves.
    """
    wanted = probes(queries.select("query", "q"), "q", dim, bits, n)
    listed = [r[0] for r in wanted.select("bucket").distinct().collect()]  # 2 ** bits at most
    index = spark.read.parquet(f"{path}/vectors").where(F.col("bucket").isin(*listed))
    index = index if keys is None else index.join(keys.select(key), key, "left_semi")
    both = index.join(wanted, "bucket")
    return both.select("query", "q", *(c for c in index.columns if c != "bucket"), F.round(vectors.cosine(F.col(vector), F.col("q")), 6).alias("score"))


def probe_knn(
    spark, path: str, queries: DataFrame, k: int, key: str, vector: str, dim: int, bits: int, n: int, keys: DataFrame | None = None
) -> DataFrame:
    """``(query, key, score, rank)``: the k best rows of each query's n nearest buckets; a query with fewer looks into all.

    ``queries`` has ``(query, q)``, q the vector. A row is no result of a query with its own key.
    """
    queries = queries.select("query", "q")
    rows = spark.read.parquet(f"{path}/vectors")
    rows = rows if keys is None else rows.join(keys.select(key), key, "left_semi")

    def best(of: DataFrame, upto: int | None) -> DataFrame:
        wanted = probes(of, "q", dim, bits, upto)
        listed = [r[0] for r in wanted.select("bucket").distinct().collect()]  # 2 ** bits at most
        own = wanted.groupBy("query").agg(F.collect_set("bucket").alias("_in"))
        looked = F.transform(F.sequence(F.lit(0), F.lit((1 << bits) - 1)), lambda b: F.array_contains("_in", b).cast("byte"))
        marked = of.join(own, "query").select("query", "q", looked.alias("mask"))
        return blocks.best(rows.where(F.col("bucket").isin(*listed)), marked, k, key, vector, dim, "bucket", "mask")

    best(queries, n).write.parquet(found := f"{path}/found-{uuid.uuid4().hex}")
    near = spark.read.parquet(found)
    full = near.where(F.col("rank") == k).select("query")
    short = queries.join(full, "query", "left_anti")
    if short.isEmpty():
        return near
    return near.join(full, "query", "left_semi").unionByName(best(short, None))


def recall_curve(exact: DataFrame, index: DataFrame, queries: DataFrame, key: str, dim: int, bits: int) -> DataFrame:
    """``(probes, recall, scored)``: what share of exact ``(query, key)`` results lies in so many buckets, and of rows they hold."""
    sequence = probes(queries.select("query", "q"), "q", dim, bits).select("query", "bucket", "probe")
    sizes = index.groupBy("bucket").agg(F.count("*").alias("rows"))
    found = exact.join(index.select(key, "bucket"), key).groupBy("query", "bucket").agg(F.count("*").alias("found"))
    each = sequence.join(sizes, "bucket", "left").join(found, ["query", "bucket"], "left").groupBy("probe")
    sums = each.agg(F.coalesce(F.sum("found"), F.lit(0)).alias("found"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))  # 2 ** bits rows
    upto = Window.orderBy("probe").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy()
    share = lambda c: F.round(F.sum(c).over(upto) / F.sum(c).over(every), 6)
    return sums.select(F.col("probe").alias("probes"), share("found").alias("recall"), share("rows").alias("scored"))


def probe_late(
    spark, path: str, query: Sequence[Sequence[float]], k: int, key: str, vector: str, held: str, dim: int, bits: int, n: int, cap: int
) -> DataFrame:
    """``(key, score)`` by late interaction of the ``cap`` rows whose mean vector is nearest to the query's, from n buckets."""
    mean = [sum(xs) / len(query) for xs in zip(*query)]
    one = spark.createDataFrame([(0, mean)], "query long, q array<double>")
    near = probe_candidates(spark, path, one, key, vector, dim, bits, n).orderBy(F.desc("score"), key).limit(cap)
    return late_search(near.select(key, held), query, k, key, held)


def sparse_rows(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """``(key, token, token_id, weight)``: hashed term weights ``ln(1 + count)``."""
    counted = docs.select(key, F.explode(tokens).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))
    return counted.select(
        key, "token", vectors.sparse_token_id(F.col("token")).alias("token_id"), F.log1p("n").alias("weight")
    )


def sparse_search(rows: DataFrame, query: Mapping[str, float], k: int, key: str) -> DataFrame:
    """``(key, score)`` of the largest sparse products; query maps tokens to weights."""
    weight = F.element_at(F.create_map(*(x for t, w in query.items() for x in (F.lit(t), F.lit(w)))), F.col("token"))
    hits = rows.where(F.col("token").isin(*query)).select(key, (F.col("weight") * weight).alias("share"))
    return hits.groupBy(key).agg(F.round(F.sum("share"), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def late_search(rows: DataFrame, query: Sequence[Sequence[float]], k: int, key: str, vectors_column: str) -> DataFrame:
    """``(key, score)`` by late interaction over rows with an array of vectors."""
    score = F.round(vectors.max_sim(F.col(vectors_column), query), 6)
    return rows.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(k)


# --- combination ---------------------------------------------------------------------------


def assemble(signals: Mapping[str, DataFrame], key: str) -> DataFrame:
    """One row per candidate of any signal with all its scores, 0 where it has none.

    Signals have ``(key, score)``; a candidate's best score counts. One shuffle
    serves all signals: a union with one aggregate, not a chain of outer joins.
    """
    rows = None
    for name, signal in signals.items():
        one = signal.select(key, F.lit(name).alias("signal"), F.col("score").cast("double").alias("score"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(key).agg(
        *(F.coalesce(F.max(F.when(F.col("signal") == n, F.col("score"))), F.lit(0.0)).alias(n) for n in signals)
    )


def hybrid(candidates: DataFrame, as_of: Column | None = None, when: str | None = None) -> DataFrame:
    """candidates with ``score``: normalised lexical and dense, sparse, late and recency by weight (fixed values)."""
    signals = [n for n in ("lexical", "dense", "sparse", "late") if n in candidates.columns]
    bounded = scoring.with_bounds(candidates, **{f"_{n}": n for n in signals})

    def normal(name: str) -> Column:
        return scoring.between(F.col(name), F.col(f"_{name}_low"), F.col(f"_{name}_high"))

    parts = {"lexical": (normal("lexical"), 0.4), "dense": (normal("dense"), 0.4)}
    for name, weight in (("sparse", 0.15), ("late", 0.1)):
        if name in signals:
            parts[name] = (F.when(F.col(name) > 0, normal(name)).otherwise(0.0), weight)
    if when is not None:
        parts["recency"] = (scoring.recency(F.col(when), as_of), 0.1)
    score = F.round(scoring.weighted(parts, optional=("sparse", "late")), 6)
    return bounded.select(*candidates.columns, score.alias("score"))


def ranked(rows: DataFrame, key: str, score: str = "score") -> DataFrame:
    """rows with ``rank`` from 1 and ``gap`` to the score before (0 for the first).

    For result lists: they are short, so one ordering window is enough.
    """
    w = Window.orderBy(F.desc(score), key)
    gap = F.greatest(F.lit(0.0), F.round(F.lag(score).over(w) - F.col(score), 6))
    return rows.withColumn("rank", F.row_number().over(w)).withColumn("gap", F.coalesce(gap, F.lit(0.0)))


def fuse(lists: Sequence[DataFrame], key: str, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ``(key, rank)`` lists: ``(key, score, best_rank, n_lists)``, best first."""
    rows = lists[0].select(key, "rank")
    for other in lists[1:]:
        rows = rows.unionByName(other.select(key, "rank"))
    fused = rows.groupBy(key).agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"),
        F.min("rank").alias("best_rank"),
        F.count("*").alias("n_lists"),
    )
    return fused.orderBy(F.desc("score"), "best_rank", key)


#: Least scores of the signals; one that is reached is enough (fixed values).
THRESHOLDS = {"lexical": 0.15, "dense": 0.15, "rerank": 0.15, "sparse": 0.10, "late": 0.10}


def over_threshold(rows: DataFrame, thresholds: Mapping[str, float] = THRESHOLDS, always: Column | None = None) -> DataFrame:
    """Rows of which any signal reaches its least score; rows for which ``always`` holds stay."""
    keep = F.lit(False) if always is None else always
    for name, least in thresholds.items():
        if name in rows.columns:
            keep = keep | F.coalesce(F.col(name) >= least, F.lit(False))
    return rows.where(keep)


def confidence(rows: DataFrame, least: float = 0.65, gap: float = 0.10) -> DataFrame:
    """One row: the first score, its gap to the second, and whether that is enough to skip fusion."""
    top = rows.where("rank <= 2").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"),
        F.max(F.when(F.col("rank") == 2, F.col("gap"))).alias("gap"),
    )
    gap_or = F.coalesce("gap", "top", F.lit(0.0))
    return top.select(
        "top", gap_or.alias("gap"), F.coalesce((F.col("top") >= least) & (gap_or >= gap), F.lit(False)).alias("confident")
    )


def rerank_head(rows: DataFrame, score: Column, head: int, key: str) -> DataFrame:
    """rows with ``position``: the first ``head`` ordered by a new score, the rest as they were."""
    marked = rows.withColumn("rerank", F.when(F.col("rank") <= head, score))
    w = Window.orderBy(F.col("rank") > head, F.desc_nulls_last("rerank"), "rank", key)
    return marked.withColumn("position", F.row_number().over(w))


def late_rerank(rows: DataFrame, late: DataFrame, key: str, weight: float = 0.2) -> DataFrame:
    """Scores mixed with normalised late scores; of several late scores of a key the lowest counts."""
    lowest = scoring.with_bounds(late.groupBy(key).agg(F.min("score").alias("late")), _late="late")
    normal = scoring.between(F.col("late"), F.col("_late_low"), F.col("_late_high"))
    lowest = lowest.select(key, normal.alias("late"))
    joined = rows.join(lowest, key, "left").withColumn("late", F.coalesce("late", F.lit(0.0)))
    return joined.withColumn("score", F.round(F.col("score") * (1 - weight) + F.col("late") * weight, 6))


def best_of_each(rows: DataFrame, by: str, *order: Column) -> DataFrame:
    """The first row of each value in an order; cut within every task before the shuffle."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token arrays: 1 when both are empty, 0 when one is."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def in_order(ids: Sequence, rows: DataFrame, key: str) -> DataFrame:
    """Rows by a list of ids, in the order of the list, with ``position``."""
    spark = rows.sparkSession
    wanted = spark.range(1).select(F.posexplode(F.array(*(F.lit(i) for i in ids))).alias("position", key))
    return rows.join(F.broadcast(wanted), key).orderBy("position")  # as many rows as the list has
