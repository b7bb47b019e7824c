"""Contracts for what users bring along: encoders, rerankers, stores, strategies, extractors, compressors, verifiers.

Functions over batches become Arrow UDFs with a declared type; objects become classes whose
methods take and give DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import structured
from tidemark.operators import search


def text_encoder(encode: Callable[[list[str]], Sequence[Sequence[float]]], dim: int) -> Callable[[Column], Column]:
    """A column function from texts to vectors; ``encode`` gets the texts of a batch. Null stays null."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            known = batch.notna()
            vectors = [list(map(float, v)) for v in encode(batch[known].tolist())]
            if any(len(v) != dim for v in vectors):
                raise ValueError(f"an encoder gave a vector that hasn't {dim} components")
            out = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            out[known] = pd.Series(vectors, index=batch.index[known], dtype=object)
            yield out

    return run


def reranker(score: Callable[[str, list[str]], Sequence[float]], query: str) -> Callable[[Column], Column]:
    """A column function from documents to scores for one query; null counts as the empty document."""

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([float(x) for x in score(query, batch.fillna("").tolist())], index=batch.index)

    return run


class VectorStore:
    """A store of vectors as a table ``(key, vector, ...)``: upsert, delete and search are pure functions of it."""

    def __init__(self, rows: DataFrame, key: str = "id", vector: str = "vector"):
        self.rows, self.key, self.vector = rows, key, vector

    def upsert(self, new: DataFrame) -> VectorStore:
        """The store with new rows in the place of those of the same key."""
        kept = self.rows.join(new.select(self.key), self.key, "left_anti")
        return VectorStore(kept.unionByName(new.select(*kept.columns)), self.key, self.vector)

    def delete(self, keys: DataFrame) -> VectorStore:
        """The store without some keys."""
        return VectorStore(self.rows.join(keys.select(self.key), self.key, "left_anti"), self.key, self.vector)

    def search(self, query: Sequence[float], k: int, where: Column | None = None) -> DataFrame:
        """``(key, score)`` of the k nearest rows."""
        return search.knn(self.rows, query, k, self.key, self.vector, where)


class Strategy(Protocol):
    """How a query finds its hits: ``(key, score)`` rows, ``limit`` at most."""

    def retrieve(self, query: str, limit: int) -> DataFrame: ...


def run_strategies(strategies: Mapping[str, Strategy], query: str, limit: int, key: str) -> DataFrame:
    """``(key, rank, strategy)`` of all strategies' hits, each list ranked on its own."""
    out = None
    for name, strategy in strategies.items():
        hits = strategy.retrieve(query, limit).orderBy(F.desc("score"), key).limit(limit)
        one = search.ranked(hits, key).select(key, "rank", F.lit(name).alias("strategy"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no strategy")
    return out


def table_extractor(rows: DataFrame, columns: Mapping[str, str], extract: Callable[[dict], Iterable[dict]]) -> DataFrame:
    """Rows of a declared table that ``extract`` finds in each input row; values that don't fit their type are null."""
    names = list(columns)
    texts = ", ".join(f"`{n}` string" for n in names)
    structured.declared_schema(columns)  # refuses unknown types

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [r for row in batch.to_dict("records") for r in extract(row)]
            yield pd.DataFrame(
                [[None if r.get(n) is None else str(r[n]) for n in names] for r in found], columns=names, dtype=object
            )

    raw = rows.mapInPandas(run, texts)
    return raw.select(*(structured.coerce(F.col(f"`{n}`"), t).alias(n) for n, t in columns.items()))


def compressor(evidence: DataFrame, by: str, order: str, body: str, compress: Callable[[list[str], list[str]], str]) -> DataFrame:
    """``(by, answer, citations)``: each question's evidence, in order, made into one answer.

    A question's evidence is a result list, so it is gathered in one row.
    """
    kind = evidence.schema[by].dataType.simpleString()
    packed = F.array_sort(F.collect_list(F.struct(order, F.col("evidence_id").alias("id"), F.col(body).alias("body"))))
    lists = evidence.groupBy(by).agg(packed.alias("all"))
    lists = lists.select(by, F.transform("all", lambda x: x["id"]).alias("ids"), F.transform("all", lambda x: x["body"]).alias("bodies"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = [compress(list(i), list(b)) for i, b in zip(batch["ids"], batch["bodies"])]
            yield pd.DataFrame({by: batch[by], "answer": answers, "citations": batch["ids"]})

    return lists.mapInPandas(run, f"`{by}` {kind}, answer string, citations array<string>")


def extractive(ids: list[str], bodies: list[str]) -> str:
    """The compressor that quotes: every text with its id, a line each."""
    return "\n".join(f"{body} [{i}]" for i, body in zip(ids, bodies))
