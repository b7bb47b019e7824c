"""A stored inverted index with positions, for phrases, prefixes and the best k of a query without scoring every hit.

Documents are dealt to *blocks* by a hash of their key, so that a block is the same set of
documents for every term. A row of the index holds a term's postings in one block, as
arrays side by side (keys, shares of the score, lengths, positions), and the greatest share among
them. Rows lie in folders by term and are sorted by term and block, so a query reads its
terms' folders and row groups only; positions and keys are delta-coded by the file format.

The best k of a query take two rounds. What a block can reach at most is the sum of its terms'
greatest shares, known without reading a posting. The most promising blocks are scored
first; their k-th score is a floor, and of the others only blocks that can reach it are scored at
all. Nothing is lost: a block below the floor holds no document among the best k.

Several columns of a document are fields of one index: positions of field f begin at
``f * FIELD_GAP``, so no phrase goes over two fields and a search can be held to one.

Keys are unique and not null (rows without a key are left out). A text of any length is
indexed as a whole; a block holds about BLOCK_DOCS documents, whatever the number of all.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions import scoring, text
from tidemark.operators.lexical import Node, parse
from tidemark.sources.tables import small_batches

#: Documents in a block, about; folders by term, each with a file of every task that had texts.
BLOCK_DOCS, PARTS = 512, 64
#: Rows of a query set (terms, or terms by block) that are handed to all tasks at most.
MOST_HANDED_OUT = 300_000
#: Terms of a block that a task hands on at a time.
TERMS_GIVEN = 4096
#: Positions between the beginnings of two fields.
FIELD_GAP = 1 << 27
#: Scores are compared with six decimals; a bound must be this much lower to rule a block out.
TOLERANCE = 1e-6


def _part(term: Column | str, parts: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


def write(
    docs: DataFrame, path: str, key: str, fields: Mapping[str, float], parts: int = PARTS, block_docs: int = BLOCK_DOCS,
    positions: bool = True,
) -> None:
    """Store an index of text columns, given with their weights, below path: postings, documents and statistics.

    Without positions it serves for the best k only, and only one field can be given.
    """
    if not positions and len(fields) > 1:
        raise ValueError("fields are told apart by positions")
    names = list(fields)
    words = [text.terms(F.coalesce(F.col(f), F.lit(""))).alias(f"t{i}") for i, f in enumerate(names)]
    length = sum((F.size(f"t{i}") for i in range(len(names))), F.lit(0)).alias("length")
    texts = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), *names)
    # Lengths come first, without a shuffle; the table of documents is what statistics are made from.
    sized = texts.select("key", *words).select("key", length).where("length > 0")
    sized.write.mode("overwrite").parquet(f"{path}/documents")
    sized = docs.sparkSession.read.schema(sized.schema).parquet(f"{path}/documents")
    n_docs, mean = sized.agg(F.count("*"), F.coalesce(F.avg("length"), F.lit(1.0))).first()
    blocks = max(1, -(-n_docs // block_docs))
    block = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")
    # Texts are shuffled by block; a block's postings are then made from arrays of its words, which never are rows of a table.
    dealt = texts.withColumn("block", block).repartition("block").sortWithinPartitions("block", "key").select("block", "key", *words)
    rows = _postings(dealt, list(fields.values()), mean, positions).withColumn("part", _part("term", parts))
    # Each task writes its blocks' rows to all folders, so the index itself is never shuffled.
    rows = rows.sortWithinPartitions("part", "term", "block")
    rows.write.mode("overwrite").option("parquet.writer.version", "v2").partitionBy("part").parquet(f"{path}/postings")
    stats = [(float(n_docs), float(mean), parts, names, rows.schema.json())]
    stats = docs.sparkSession.createDataFrame(stats, "n_docs double, mean_length double, parts int, fields array<string>, schema string")
    stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")


def _postings(dealt: DataFrame, weights: Sequence[float], mean: float, positions: bool) -> DataFrame:
    """Index rows from ``(block, key, t0, t1, ...)`` rows in order of block and key, t the words of each field.

    A task holds the words of one block at a time, as numbers beside a list of distinct ones.
    """
    key_kind, mean, fields = dealt.schema["key"].dataType.simpleString(), float(mean), range(len(weights))
    kinds = {"block": "int", "term": "string", "n": "bigint", "top": "double", "keys": f"array<{key_kind}>", "shares": "array<double>"}
    kinds |= {"lengths": "array<int>", "positions": "array<array<int>>"} if positions else {}

    def lists(ends: np.ndarray, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values)

    def rows_of(table: pa.Table) -> Iterator[pa.RecordBatch]:
        parts, docs, places = [], [], []
        length = np.zeros(table.num_rows, np.int64)
        for f in fields:
            column = table.column(2 + f).combine_chunks()
            counts = np.diff(np.asarray(column.offsets))
            length += counts
            parts.append(column.flatten())
            docs.append(np.repeat(np.arange(table.num_rows), counts))
            places.append(np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + f * FIELD_GAP)
        coded = pa.chunked_array(parts, pa.string()).combine_chunks()
        coded = (coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded).dictionary_encode()
        code, doc, place = np.asarray(coded.indices), np.concatenate(docs), np.concatenate(places).astype(np.int32)
        if not len(code):
            return
        order = np.lexsort((place, doc, code))
        code, doc, place = code[order], doc[order], place[order]
        first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])]))  # of each posting
        ends = np.append(first[1:], len(code))
        code_of, doc_of = code[first], doc[first]
        tf = np.zeros(len(first))
        for f, w in zip(fields, weights):
            upto = np.concatenate([[0], np.cumsum(place // FIELD_GAP == f)])
            tf += w * (upto[ends] - upto[first])
        shares = tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length[doc_of] / mean))
        begin = np.flatnonzero(np.concatenate([[True], code_of[1:] != code_of[:-1]]))  # of each term
        last = np.append(begin[1:], len(first))
        keys, block = table.column(1).combine_chunks(), table.column(0)[0].as_py()
        for low in range(0, len(begin), TERMS_GIVEN):
            at, upto = begin[low : low + TERMS_GIVEN], last[low : low + TERMS_GIVEN]
            own = slice(int(at[0]), int(upto[-1]))
            columns = [
                pa.array(np.full(len(at), block, np.int32)), coded.dictionary.take(pa.array(code_of[at])), pa.array(upto - at, pa.int64()),
                pa.array(np.maximum.reduceat(shares[own], at - own.start)),
                lists(upto - own.start, keys.take(pa.array(doc_of[own]))), lists(upto - own.start, pa.array(shares[own])),
            ]
            if positions:
                inner = lists(ends[own] - first[own.start], pa.array(place[first[own.start] : ends[own.stop - 1]]))
                columns += [lists(upto - own.start, pa.array(length[doc_of[own]], pa.int32())), lists(upto - own.start, inner)]
            yield pa.RecordBatch.from_arrays(columns, list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            marks = np.asarray(batch.column(0))
            cuts = np.concatenate([[0], np.flatnonzero(marks[1:] != marks[:-1]) + 1, [len(marks)]]) if len(marks) else [0]
            for low, high in zip(cuts[:-1], cuts[1:]):
                if held and held[0].column(0)[0].as_py() != int(marks[low]):
                    yield from rows_of(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(low, high - low))
        if held:
            yield from rows_of(pa.Table.from_batches(held))

    small_batches(dealt.sparkSession)
    return dealt.mapInArrow(run, ", ".join(f"{c} {kind}" for c, kind in kinds.items()))


def _shifted(positions: Column, by: int) -> Column:
    return F.transform(F.coalesce(positions, F.array().cast("array<int>")), lambda p: p - by)


def in_field(positions: Column, i: int) -> Column:
    return F.filter(positions, lambda p: (p >= i * FIELD_GAP) & (p < (i + 1) * FIELD_GAP))


def _stats(spark: SparkSession, path: str):
    return spark.read.parquet(f"{path}/stats").first()


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows of an index, which may have none."""
    return spark.read.schema(StructType.fromJson(json.loads(_stats(spark, path)["schema"]))).parquet(f"{path}/postings")


def folders(spark: SparkSession, path: str, terms: DataFrame, parts: int) -> DataFrame:
    """The index rows in the folders of some terms; which ones is settled before the scan."""
    wanted = [r[0] for r in terms.select(_part("term", parts)).distinct().collect()]  # parts at most
    return _rows(spark, path).where(F.col("part").isin(*wanted))


# --- the best k ------------------------------------------------------------------------------


def bounded(spark: SparkSession, path: str, queries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(weights, bounds, index)`` for ``(query, term)`` rows.

    Weights are ``(query, term, idf)``; bounds ``(query, block, bound, n, docs)``: what a block can
    reach, its postings, and a number of documents with a term that it holds at least.
    """
    stats = _stats(spark, path)
    queries = queries.select("query", "term").distinct()
    terms = _handed_out(queries.select("term").distinct())
    index = folders(spark, path, terms, stats["parts"]).join(terms, "term", "left_semi")
    heads = index.select("term", "block", "n", "top")
    df = heads.groupBy("term").agg(F.sum("n").alias("df"))
    odds = (F.lit(stats["n_docs"]) - F.col("df") + 0.5) / (F.col("df") + 0.5)
    idf = F.when(F.log(odds) > 0, F.log(odds)).otherwise(F.lit(1e-6))
    weights = queries.join(df, "term").select("query", "term", idf.alias("idf"))
    bounds = weights.join(heads, "term").groupBy("query", "block")
    bounds = bounds.agg(F.sum(F.col("idf") * F.col("top")).alias("bound"), F.sum("n").alias("n"), F.max("n").alias("docs"))
    return weights, bounds, index


def _handed_out(rows: DataFrame) -> DataFrame:
    """rows for every task where they are few, which is counted first, so that the index isn't shuffled to meet them."""
    few = rows.limit(MOST_HANDED_OUT + 1).checkpoint()
    return F.broadcast(few) if few.count() <= MOST_HANDED_OUT else rows


def scores(weights: DataFrame, chosen: DataFrame, index: DataFrame) -> DataFrame:
    """``(query, key, bm25)`` of the documents in chosen ``(query, block)`` rows."""
    pairs = _handed_out(weights.join(chosen.select("query", "block"), "query"))
    hits = pairs.join(index.select("term", "block", "keys", "shares"), ["term", "block"])
    each = hits.select("query", "idf", F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("shares").alias("share"))))
    return each.groupBy("query", "key").agg(F.round(F.sum(F.col("idf") * F.col("share")), 6).alias("bm25"))


def rounds(bounds: DataFrame, weights: DataFrame, index: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(first, second, scores of the first)``: the blocks that are scored in each round."""
    order = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
    before = F.coalesce(F.sum("docs").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = bounds.withColumn("before", before).where(F.col("before") < k).drop("before").checkpoint()
    seen = scores(weights, first, index).checkpoint()
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bm25"), "key"))
    floor = seen.withColumn("place", place).where(F.col("place") == k).select("query", F.col("bm25").alias("floor"))
    rest = bounds.join(first.select("query", "block"), ["query", "block"], "left_anti")
    second = rest.join(floor, "query").where(F.col("bound") >= F.col("floor") - TOLERANCE).drop("floor")
    return first, second, seen


def top_k(spark: SparkSession, path: str, queries: DataFrame, k: int, key: str) -> DataFrame:
    """``(query, key, bm25, rank)``: the k best documents of each query, given as ``(query, term)`` rows; ties to the smaller key.

    A first round that leaves no floor has scored every block of the query.
    """
    _checkpoints(spark, path)
    weights, bounds, index = bounded(spark, path, queries)
    weights, bounds = weights.checkpoint(), bounds.checkpoint()
    _, second, seen = rounds(bounds, weights, index, k)
    every = seen.unionByName(scores(weights, second, index))
    order = Window.partitionBy("query").orderBy(F.desc("bm25"), "key")
    ranked = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query", F.col("key").alias(key), "bm25", "rank")


def read_share(spark: SparkSession, path: str, queries: DataFrame, k: int) -> DataFrame:
    """One row ``(blocks, blocks_scored, postings, postings_scored)``: what top_k spares for these queries."""
    _checkpoints(spark, path)
    weights, bounds, index = bounded(spark, path, queries)
    bounds = bounds.checkpoint()
    first, second, _ = rounds(bounds, weights, index, k)
    scored = first.unionByName(second).agg(F.count("*").alias("blocks_scored"), F.coalesce(F.sum("n"), F.lit(0)).alias("postings_scored"))
    every = bounds.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("postings"))
    return every.join(F.broadcast(scored)).select("blocks", "blocks_scored", "postings", "postings_scored")  # one row


def _checkpoints(spark: SparkSession, path: str) -> None:
    """Intermediate tables lie beside the index, which all executors see, unless the session has a folder for them."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or f"{path}/rounds")


# --- boolean queries ---------------------------------------------------------------------------


def leaves(tree: Node) -> list[Node]:
    """The distinct terms, prefixes and phrases of a query, in order."""
    if tree.kind in ("term", "prefix", "phrase"):
        return [tree]
    return list(dict.fromkeys(x for part in tree.parts for x in leaves(part)))


def _holds(tree: Node, found: Mapping[Node, Column]) -> Column:
    if tree in found:
        return found[tree]
    parts = [_holds(p, found) for p in tree.parts]
    if tree.kind == "not":
        return ~parts[0]
    return reduce((lambda a, b: a & b) if tree.kind == "and" else or_, parts)


def _empty_matches(tree: Node) -> bool:
    """Whether a document without any of a query's leaves matches."""
    if tree.kind in ("term", "prefix", "phrase"):
        return False
    parts = [_empty_matches(p) for p in tree.parts]
    return not parts[0] if tree.kind == "not" else all(parts) if tree.kind == "and" else any(parts)


def _occurrences(leaf: Node, at: Mapping[str, str], prefixes: Mapping[str, str]) -> Column:
    """How often a leaf occurs, from the columns of its words' positions."""
    if leaf.kind == "prefix":
        return F.coalesce(F.col(prefixes[leaf.parts[0]]), F.lit(0))
    starts = [_shifted(F.col(at[word]), i) for i, word in enumerate(leaf.parts)]
    return F.size(reduce(F.array_intersect, starts))


def search(spark: SparkSession, path: str, query: str, key: str, field: str | None = None) -> DataFrame:
    """``(key, bm25)`` of the documents that a boolean query matches, in one field or in all.

    Every term, prefix and phrase of the query counts as a term of its own in the score. Only
    the folders of the query's words are read; a prefix looks into all of them, with the range of
    terms pushed to the scan.
    """
    stats = _stats(spark, path)
    tree = parse(query)
    every = leaves(tree)
    words = list(dict.fromkeys(w for x in every if x.kind != "prefix" for w in x.parts))
    starts = list(dict.fromkeys(x.parts[0] for x in every if x.kind == "prefix"))
    if starts:
        index = _rows(spark, path)
    else:
        index = folders(spark, path, spark.createDataFrame([(w,) for w in words], "term string"), stats["parts"])
    wanted = [F.col("term").isin(*words)] if words else []
    hits = index.where(reduce(or_, wanted + [F.col("term").startswith(s) for s in starts]))
    hits = hits.select("term", F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("lengths").alias("length"), F.col("positions").alias("positions"))))
    if field is not None:
        own = in_field(F.col("positions"), stats["fields"].index(field))
        hits = hits.withColumn("positions", own).where(F.size("positions") > 0)
    at = {w: f"at{i}" for i, w in enumerate(words)}
    before = {s: f"before{i}" for i, s in enumerate(starts)}
    counted = hits.groupBy("key", "length").agg(
        *(F.first(F.when(F.col("term") == w, F.col("positions")), ignorenulls=True).alias(c) for w, c in at.items()),
        *(F.sum(F.when(F.col("term").startswith(s), F.size("positions"))).cast("int").alias(c) for s, c in before.items()),
    )
    counted = counted.select("key", "length", *(_occurrences(x, at, before).alias(f"tf{i}") for i, x in enumerate(every)))
    df = counted.agg(*(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(every))))  # one row
    if _empty_matches(tree):
        none = [F.coalesce(f"tf{i}", F.lit(0)).alias(f"tf{i}") for i in range(len(every))]
        counted = spark.read.parquet(f"{path}/documents").join(counted.drop("length"), "key", "left").select("key", "length", *none)
    joined = counted.join(F.broadcast(df)).where(_holds(tree, {x: F.col(f"tf{i}") > 0 for i, x in enumerate(every)}))
    score = F.lit(0.0)
    for i in range(len(every)):
        part = scoring.bm25_weight(F.col(f"tf{i}"), F.col("length"), F.lit(stats["mean_length"]), F.lit(stats["n_docs"]), F.col(f"df{i}"))
        score = score + F.when(F.col(f"tf{i}") > 0, part).otherwise(0.0)
    return joined.select(F.col("key").alias(key), score.alias("bm25"))


def rarest(spark: SparkSession, path: str, queries: DataFrame) -> DataFrame:
    """``(query, key)``: the documents that hold each query's rarest term (the first of those in code-point order)."""
    _checkpoints(spark, path)
    weights, _, index = bounded(spark, path, queries)
    first = weights.groupBy("query").agg(F.min_by("term", F.struct(-F.col("idf"), "term")).alias("term"))
    return first.join(index.select("term", F.explode("keys").alias("key")), "term").select("query", "key")


def as_queries(spark: SparkSession, named: Mapping[str, Sequence[str]]) -> DataFrame:
    """``(query, term)`` rows of queries given as lists of terms."""
    return spark.createDataFrame([(q, t.lower()) for q, ts in named.items() for t in ts], "query string, term string")
