"""Token counts of whole texts, without making any token ids.

Method: *heap-and-linked-list merging*. The symbols of a piece form a linked
list, its adjacent pairs a heap by rank; the lowest is popped and merged until
none is left. A piece counts its initial symbols minus its merges; a text is the
sum over its pieces, plus one for each special string in it. Counts of short
pieces are remembered within a worker.

Edge cases: null and empty texts have no bytes and no tokens; white space alone
has no tokens; rows are independent, so repeated rows give repeated results; an
empty table gives an empty table; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, session_of, text_chunks
from .word_bpe import MergeList, Remembered, WordBpe, load


class PieceCounts(Remembered):
    """Piece to number of tokens, filled on demand up to a bound."""

    def __init__(self, bpe: WordBpe):
        super().__init__(self.count)
        self.bpe = bpe

    def count(self, piece: str) -> int:
        """Initial symbols minus merges."""
        symbols = self.bpe.symbols(piece)
        return len(symbols) - MergeList(symbols, self.bpe.merges).run()


def count_text(text: str, counts: PieceCounts) -> int:
    """Tokens of a whole text."""
    look = counts.__getitem__
    return sum(
        1 if special is not None else sum(map(look, pieces))
        for pieces, special in counts.bpe.segments(text)
    )


@lru_cache(maxsize=2)
def piece_counts(path: str) -> PieceCounts:
    """Counts for a vocabulary file; a worker keeps them between tasks."""
    return PieceCounts(load(path))


def token_counts(
    docs: DataFrame, vocabulary: str, limit: int = 2048, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(key, n_bytes, n_tokens, over_limit)`` for every row of docs."""
    session_of(docs)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = piece_counts(vocabulary)
        for part, texts in text_chunks(batches, 1):
            size = pc.binary_length(part.column(1))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pc.fill_null(size, 0).cast(pa.int64()),
                    pa.array([count_text(x, counts) for x in texts], pa.int64()),
                ],
                ["key", "n_bytes", "n_tokens"],
            )

    out = docs.select(column(key), column(text)).mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long")
    return out.withColumnRenamed("key", key).withColumn("over_limit", F.col("n_tokens") > limit)
