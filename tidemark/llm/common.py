"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: a run of characters other than ASCII white space (fixed by the result contract).
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes in one Arrow batch from the JVM. Texts can be long, so both are far below Spark's defaults.
BATCH_ROWS, BATCH_BYTES = 512, "16m"

#: Characters of text that a Python worker turns into arrays at a time.
CHUNK_CHARS = 1_000_000

ASCII_LOWER = bytes.maketrans(
    bytes(range(ord("A"), ord("Z") + 1)), bytes(range(ord("a"), ord("z") + 1))
)


def session_of(df: DataFrame) -> SparkSession:
    """The session of df, with Arrow batches small enough for long texts.

    Batches are formed when a query runs, after this returns, so the session keeps the
    settings. They are only ever lowered.
    """
    spark = df.sparkSession
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where that is unset a temporary folder serves, but only on one machine: executors of a
    cluster could not see it.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not named and not sc.master.partition("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or tempfile.mkdtemp(prefix="tidemark-")).rstrip("/")


#: Lets adaptive execution end a query whose result is empty for certain while tasks still read tables that it no longer needs.
_EARLY_END = "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation"


@contextmanager
def all_stages_end(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside end after all their stages, so what they have read can be deleted then.

    Else a stage may stay behind where the other side of a join is empty, and its job fails once its files are gone.
    """
    name = "spark.sql.adaptive.optimizer.excludedRules"
    before = spark.conf.get(name, None)
    spark.conf.set(name, f"{before},{_EARLY_END}" if before else _EARLY_END)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def materialise(df: DataFrame) -> DataFrame:
    """df written to the reliable checkpoint folder, so that its lineage ends here. Nothing reads its inputs any more then."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    with all_stages_end(df.sparkSession):
        return df.checkpoint(eager=True)


def discard(*frames: DataFrame | None) -> None:
    """Delete the files of materialised frames that nothing will read again."""
    for df in frames:
        if df is None:
            continue
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            remove(df.sparkSession, file.get())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def column(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """Names that clash with no taken one, whatever the case."""
    low = {t.lower() for t in taken}
    out = []
    for name in wanted:
        while name.lower() in low:
            name += "_"
        out.append(name)
    return out


def word_count(text: Column) -> Column:
    """Number of words; null counts as the empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo modulus; null keys belong to fold 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % modulus, F.lit(0)).cast("int")


def text_chunks(batches, text_at: int, limit: int = CHUNK_CHARS):
    """Record batches cut so that each holds about ``limit`` bytes of text at most.

    A single longer text is a batch by itself. Yields ``(batch, texts)`` with
    null texts as empty strings.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(text_at)
        sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0))
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                part = batch.slice(start, i - start)
                yield part, [x or "" for x in part.column(text_at).to_pylist()]
                start, held = i, 0
            held += int(n)
        part = batch.slice(start)
        yield part, [x or "" for x in part.column(text_at).to_pylist()]


# --- vectorised 64-bit hashing -------------------------------------------------

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on a uint64 array."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASE = 0x2545F4914F6CDD1D


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


#: Bytes of text that are hashed at a time; the working arrays take some 30 times as much.
SLICE_BYTES = 2_000_000


def _run_hashes(joined: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes before mixing) of the runs of bytes that aren't in the table ``cut``."""
    gap = cut[joined]
    before = np.empty_like(gap)
    before[0] = True
    before[1:] = gap[:-1]
    starts = np.flatnonzero(~gap & before)
    ends = np.flatnonzero(gap & ~before)
    if len(ends) < len(starts):
        ends = np.append(ends, len(joined))
    if not len(starts):
        return starts, ends, np.empty(0, np.uint64)
    # Every byte's value times the base to its place in its run; gaps count as places too, unused.
    gaps = np.diff(starts, append=len(joined))
    place = np.arange(starts[0], len(joined), dtype=np.int32) - np.repeat(starts.astype(np.int32), gaps)
    power = np.full(int(gaps.max()), _BASE, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    values = _BYTE_VALUES[joined[starts[0] :]]
    values *= power[place]
    del place
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return starts, ends, total[ends - starts[0]] - total[starts - starts[0]]


def run_hashes(text: bytes, cut: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, 64-bit hashes) of a text's runs of bytes that aren't in ``cut``.

    The text is gone through in slices of SLICE_BYTES; a run that goes on in the next slice
    is put together from its parts, so a hash doesn't depend on where slices end.
    """
    found: list[list[np.ndarray]] = [[], [], []]
    whole = np.frombuffer(text, np.uint8)
    for at in range(0, len(whole), SLICE_BYTES):
        starts, ends, hashes = _run_hashes(whole[at : at + SLICE_BYTES], cut)
        starts, ends = starts + at, ends + at
        if found[1] and len(starts) and starts[0] == at and found[1][-1][-1] == at:
            done = int(found[1][-1][-1] - found[0][-1][-1])
            with np.errstate(over="ignore"):
                found[2][-1][-1] += _U(pow(_BASE, done, 1 << 64)) * hashes[0]
            found[1][-1][-1] = ends[0]
            starts, ends, hashes = starts[1:], ends[1:], hashes[1:]
        if len(starts):
            for part, x in zip(found, (starts, ends, hashes)):
                part.append(x)
    if not found[0]:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    starts, ends, hashes = (np.concatenate(x) for x in found)
    return starts, ends, mix64(hashes + (ends - starts).astype(np.uint64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts in order, and each text's word count."""
    if len(texts) == 1:  # a long text comes alone
        hashes = run_hashes(texts[0])[2]
        return hashes, np.array([len(hashes)], np.int64)
    starts, _, hashes = run_hashes(b" ".join(texts) + b" ")
    last = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in texts]))
    return hashes, np.diff(last, prepend=0)
