"""Importance resampling of documents towards a target set, by hashed word n-grams.

Method: *external sort-count*. Every text becomes a stream of its features'
buckets, packed as uint16 and written with the offsets at which documents begin.
Counts come from the written streams: each is sorted (a radix sort, as the values
have 16 bits) and run-length encoded, runs are added up within the task and then
over all tasks. Gains per bucket follow from the counts of documents and target
set, and a second reading of the streams gathers them: a document's weight is
``np.add.reduceat(gains[stream], offsets)``. Texts are read and hashed only once.

Features are all runs of one to three words, hashed by CRC-32. No n-gram is put
together as a string: CRC-32 is linear, so ``crc(x y) = shift(crc(x), len(y)) ^
crc(y)``, where shifting by a number of bytes is four table look-ups.

The draw is Gumbel's: a weight plus noise that depends on the id only, and the
highest scores win. Scores are dealt to buckets by approximate quantiles and only
buckets that reach into the draw are ordered, so no task orders all rows.

Edge cases: a null or empty text, or one without words, has no features and weight 0;
texts with few words are never drawn but get a score; a null id counts as the
empty string in the noise and comes last among ties; rows that repeat are drawn
each for itself, next to each other; an empty target set or table counts nothing,
so gains are finite; other columns aren't looked at. Long texts are hashed in slices
of 2 MB; what a task holds beyond a text is 6 bytes for each word of it.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, SLICE_BYTES, column, materialise, remove, session_of, shared_folder, text_chunks

BUCKETS, MOST_WORDS = 10_000, 3
#: Buckets of scores that the draw is ordered in.
PARTS = 64

_U32 = np.uint32

# --- CRC-32 of many strings at once --------------------------------------------

#: Strings of up to so many bytes go by tables of their own length.
SHORT = 64


def _advanced(crc: np.ndarray) -> np.ndarray:
    """CRC registers after one more zero byte."""
    for _ in range(8):
        crc = (crc >> _U32(1)) ^ (_U32(0xEDB88320) * (crc & _U32(1)))
    return crc


def _look_up(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map of registers that is given for each of their four bytes."""
    out = tables[0][crc & _U32(255)]
    for k in (1, 2, 3):
        out = out ^ tables[k][(crc >> _U32(8 * k)) & _U32(255)]
    return out


def _shift_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Maps for 0 to SHORT zero bytes, and for SHORT * 2**j of them."""
    maps = [np.arange(256, dtype=_U32)[None, :] << np.array([[0], [8], [16], [24]], _U32)]
    for _ in range(SHORT):
        maps.append(_advanced(maps[-1]))
    powers = [maps[SHORT]]
    for _ in range(26):
        powers.append(_look_up(powers[-1], powers[-1]))
    return np.stack(maps), powers


_BY_LENGTH, _BY_POWER = _shift_tables()
#: A byte's part in a CRC by its distance to the end, and what ends and lengths add.
_BYTE = np.ascontiguousarray(_BY_LENGTH[:, 0, :]).ravel()
_FLAT = np.ascontiguousarray(_BY_LENGTH).ravel()


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``crc`` of strings once ``n`` zero bytes follow them (without the constants at the ends)."""
    at = (n % SHORT).astype(np.int64) << 10
    out = _FLAT[at + (crc & _U32(255))]
    for k in (1, 2, 3):
        out ^= _FLAT[at + (k << 8) + ((crc >> _U32(8 * k)) & _U32(255))]
    far = n // SHORT
    for j in range(int(far.max(initial=0)).bit_length()):
        some = np.flatnonzero(far >> j & 1)
        out[some] = _look_up(_BY_POWER[j], out[some])
    return out


def run_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of ``data[start:end]`` for runs that are not empty."""
    size = ends - starts
    out = np.empty(len(size), _U32)
    long = size > SHORT
    for i in np.flatnonzero(long):
        out[i] = zlib.crc32(data[starts[i] : ends[i]])
    short = np.flatnonzero(~long)
    if len(short):
        n, first = size[short], starts[short]
        begin = np.cumsum(n) - n
        place = np.arange(int(n.sum()))
        within = place - np.repeat(begin, n)
        left = np.repeat(n, n) - within
        parts = _BYTE[(left << 8) + data[np.repeat(first, n) + within]]
        ones = np.full(len(n), 0xFFFFFFFF, _U32)
        out[short] = np.bitwise_xor.reduceat(parts, begin) ^ shifted(ones, n) ^ _U32(0xFFFFFFFF)
    return out


# --- features ------------------------------------------------------------------

#: Bytes outside words, once A-Z are lower-cased (fixed by the result contract).
_CUT = np.zeros(256, bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    _CUT[_low : _high + 1] = True
_SPACE = np.array([zlib.crc32(b" ")], _U32)


def _runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = ~_CUT[data]
    change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        change = np.append(0, change)
    if len(change) % 2:
        change = np.append(change, len(data))
    return change[::2], change[1::2]


def _grams(data: np.ndarray, before: tuple[int, int] = (0, 0)) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    """(starts, buckets of the runs of 1, 2 and 3 words that end at each word, CRCs of the last word and pair).

    ``before`` has the CRCs of the last word and pair of what came before.
    """
    starts, ends = _runs(data)
    if not len(starts):
        return starts, np.empty((0, MOST_WORDS), np.uint16), before
    one = run_crcs(data, starts, ends)
    size = ends - starts
    with_space = shifted(np.repeat(_SPACE, len(size)), size) ^ one
    two = shifted(np.append(_U32(before[0]), one[:-1]), size + 1) ^ with_space
    three = shifted(np.append(_U32(before[1]), two[:-1]), size + 1) ^ with_space
    return starts, (np.stack([one, two, three], 1) % _U32(BUCKETS)).astype(np.uint16), (int(one[-1]), int(two[-1]))


def _slices(text: bytes) -> Iterator[np.ndarray]:
    """A text in slices of about SLICE_BYTES that end between words."""
    whole, at = np.frombuffer(text, np.uint8), 0
    while at < len(whole):
        end = at + SLICE_BYTES
        while end < len(whole):
            gap = _CUT[whole[end : end + SLICE_BYTES]]
            if gap.any():
                end += int(gap.argmax())
                break
            end += SLICE_BYTES
        yield whole[at:end]
        at = end


def packed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and the buckets of all features of all texts one after another as uint16."""
    texts = [t.translate(ASCII_LOWER) for t in texts]
    if len(texts) == 1:
        parts, before = [], (0, 0)
        for data in _slices(texts[0]):
            _, grams, before = _grams(data, before)
            parts.append(grams)
        grams = np.concatenate(parts) if parts else np.empty((0, MOST_WORDS), np.uint16)
        n_words = np.array([len(grams)])
    else:
        starts, grams, _ = _grams(np.frombuffer(b" ".join(texts), np.uint8))
        last = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
        n_words = np.diff(last, prepend=0)
    real = np.ones(grams.shape, bool)
    first = np.cumsum(n_words) - n_words
    for k in range(1, MOST_WORDS):  # the first words of a text end no longer runs
        for at in range(k):
            real[(first + at)[n_words > at], k] = False
    return n_words, grams[real]


def features_of(n_words: np.ndarray) -> np.ndarray:
    """Runs of 1 to MOST_WORDS words in texts of so many words."""
    return sum(np.maximum(n_words - k, 0) for k in range(MOST_WORDS))


def write_streams(docs: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """Packed streams of docs as a Parquet table at path: ``(ids, n_words, offsets, stream)``.

    A row holds the documents of about a megabyte of text; offsets are those at which
    their features begin in the stream.
    """
    rows = docs.select(column(key).alias("id"), column(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, 1):
            n_words, stream = packed([t.encode() for t in texts])
            n = features_of(n_words)
            offsets = np.cumsum(n) - n
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            columns = [
                one(batch.column(0)), one(pa.array(n_words, pa.int64())), one(pa.array(offsets, pa.int64())),
                pa.array([stream.astype("<u2").tobytes()], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["ids", "n_words", "offsets", "stream"])

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"ids array<{kind}>, n_words array<long>, offsets array<long>, stream binary"
    rows.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def bucket_counts(streams: DataFrame) -> np.ndarray:
    """How often each bucket occurs in the streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                ordered = np.sort(np.frombuffer(raw.as_py(), "<u2"), kind="stable")
                if len(ordered):
                    at = np.flatnonzero(np.diff(ordered, prepend=ordered[0] ^ 1))
                    total[ordered[at]] += np.diff(at, append=len(ordered))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], ["bucket", "n"])

    counts = streams.select("stream").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in counts.collect():  # BUCKETS rows at most
        out[bucket] = n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B))))`` of every bucket."""
    all_s, all_t = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    ratio = ((target + 1.0) * all_s) / ((source + 1.0) * all_t)
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def gathered(streams: DataFrame, gains: np.ndarray) -> DataFrame:
    """``(id, n_words, n_features, weight)`` for every document of the streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, words, offsets, raw in zip(*(batch.column(k) for k in range(4))):
                n_words = words.values.to_numpy()
                n = features_of(n_words)
                weight = np.zeros(len(n), np.int64)
                some = n > 0  # an empty document has no stretch of its own in the stream
                if some.any():
                    stream = np.frombuffer(raw.as_py(), "<u2")
                    weight[some] = np.add.reduceat(gains[stream], offsets.values.to_numpy()[some])
                yield pa.RecordBatch.from_arrays(
                    [ids.values, pa.array(n_words), pa.array(n), pa.array(weight)], ["id", "n_words", "n_features", "weight"]
                )

    kind = streams.schema["ids"].dataType.elementType.simpleString()
    return streams.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")


def scored(docs: DataFrame, target: DataFrame, key: str, text: str, target_text: str, seed: int) -> DataFrame:
    """``(id, n_words, n_features, weight, score)`` for every row of docs, materialised; the streams are deleted."""
    spark = session_of(docs)
    base = f"{shared_folder(spark)}/streams-{uuid.uuid4().hex}"
    streams = write_streams(docs, key, text, f"{base}/documents")
    wanted = write_streams(target.withColumn("_none", F.lit(0)), "_none", target_text, f"{base}/target")
    rows = gathered(streams, bucket_gains(bucket_counts(streams), bucket_counts(wanted)))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = materialise(rows.withColumn("score", F.col("weight") + noise))
    remove(spark, base)
    return rows


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42,
    key: str = "doc_id", text: str = "text", target_text: str = "text",
) -> DataFrame:
    """``(key, n_features, weight, score, rank)`` for every row of docs.

    Of the n documents with ``least_words`` words or more, ``percent * n // 100`` of the
    highest scores are drawn, ties to the smaller id, and ranked from 1; the others' rank is null.
    """
    rows = scored(docs, target, key, text, target_text, seed)
    able = rows.where(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    # Only what lies above the draw's lower end is cut into parts.
    share = max(1e-9, percent / 100)
    levels = [max(0.0, 1 - share * k / PARTS) for k in range(1, PARTS + 1)]
    cuts = sorted(set(able.approxQuantile("score", levels, share / PARTS / 2))) if drawn else []
    edges = F.lit(np.array(cuts, float)) if cuts else F.expr("array()").cast("array<double>")
    part = F.size(F.filter(edges, lambda c: c <= F.col("score")))
    dealt = rows.withColumn("part", F.when(F.col("n_words") >= least_words, part).otherwise(-1))
    sizes = dict(dealt.groupBy("part").count().collect())  # PARTS + 2 rows at most
    above, before = {}, 0
    for p in sorted(sizes, reverse=True):
        if p >= 0 and before < drawn:
            above[p], before = before, before + sizes[p]
    out = [F.col("id").alias(key), "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if not above:
        return rows.select(*out, none)
    lowest = min(above)
    starts = F.element_at(F.create_map(*(F.lit(x) for p in above.items() for x in p)), F.col("part")).cast("long")
    # Equal rows are one row with a count while they are ordered.
    heads = dealt.where(F.col("part") >= lowest).groupBy("part", "id", "n_features", "weight", "score").agg(F.count("*").alias("copies"))
    order = Window.partitionBy("part").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "n_features", "weight")
    upto = starts + F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = heads.withColumn("upto", upto).withColumn("place", F.explode(F.expr("sequence(upto - copies + 1, upto)")))
    rank = F.when(F.col("place") <= drawn, F.col("place")).alias("rank")
    return ranked.select(*out, rank).unionByName(dealt.where(F.col("part") < lowest).select(*out, none))
