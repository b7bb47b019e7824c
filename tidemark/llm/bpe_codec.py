"""Encoding and decoding whole texts with a word-end byte-pair vocabulary.

Method: *tree concatenation*. A normalised text of more than ``LEAF_CHARS``
characters is cut in halves, again and again, wherever the middle falls: within
words too. The leaves are split into pieces and encoded on their own, and
neighbours are joined level by level. At each join a window around the cut is
split and encoded anew; it begins and ends at white space, and doubles until its
first piece is the left side's and its last piece the right side's. No piece goes
through white space and splitting never looks past it, so what lies outside the
window is as if the whole had been split at once.

A piece that goes through the cut is encoded anew too. If it is long, its tokens
are joined instead: the last tokens of the left side and the first of the right
are merged anew, more and more of them, until the new tokens begin with the left
side's first one in the window and end with the right side's last one. Then all
adjacent tokens are such as merging leaves apart, and rank-ordered merging never
crosses a boundary whose two tokens, taken alone, stay apart. So a join is exact
at every level, however long a text or a word.

Halves are encoded in parallel by tasks: texts of more than ``PART_BYTES`` are cut
into parts that a shuffle deals out to all tasks, and the encoded parts of a text are
joined as a tree afterwards. Within a part leaves follow each other, since
merging holds the interpreter lock and other cores have tasks of their own.

Edge cases: a null text encodes as the empty text (no ids, empty decoded text);
a text of white space alone has no ids; strings of special tokens inside a text
become their ids, as the library does by default; rows are independent, so
repeated rows and repeated ids give repeated results (equal rows of a long text are
encoded once and come as often as they were there); an empty table gives an
empty table. Extra columns are not looked at. The table is read twice, by its long
and by its other texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, session_of, text_chunks
from .word_bpe import ID_BITS, ID_MASK, Remembered, WordBpe, encode_symbols, load, split

#: Characters in a leaf at most: longer texts are cut in halves.
LEAF_CHARS = 1024
#: Bytes of a text beyond which its parts are dealt out to tasks, and characters in a part.
PART_BYTES, PART_CHARS = 65_536, 32_768
#: Tokens on either side of a join within a word in the first window.
FIRST_WINDOW = 4
#: Characters on either side of a join in the first window.
FIRST_CHARS = 48
#: Pieces of more characters than this are joined by tokens.
LONG_PIECE = 48


def join_runs(left: list[int], right: list[int], bpe: WordBpe, first: int = FIRST_WINDOW) -> list[int]:
    """The exact encoding of one piece from the encodings of its two parts, each encoded as a piece."""
    if not left or not right:
        return left + right
    width = first
    while True:
        a, b = left[-width:], right[:width]
        base = [s for t in a for s in bpe_symbols(t, bpe)]
        base[-1] = bpe.unended[base[-1]]  # the left part isn't the end of the word any more
        base += (s for t in b for s in bpe_symbols(t, bpe))
        new = encode_symbols(base, bpe.merges)
        left_done = len(a) == len(left) or new[0] == a[0]
        right_done = len(b) == len(right) or new[-1] == b[-1]
        if left_done and right_done:
            return left[: len(left) - len(a)] + new + right[len(b) :]
        width *= 2


def bpe_symbols(token: int, bpe: WordBpe) -> list[int]:
    """The base symbols that a token was merged from."""
    table = bpe.__dict__.setdefault("_parts", {})
    known = table.get(token)
    if known is None:
        halves = bpe.__dict__.get("_splits")
        if halves is None:
            halves = bpe._splits = {}
            for pair, merged in bpe.merges.items():
                halves.setdefault(merged & ID_MASK, (pair >> ID_BITS, pair & ID_MASK))
        pair = halves.get(token)
        known = [token] if pair is None else bpe_symbols(pair[0], bpe) + bpe_symbols(pair[1], bpe)
        table[token] = known
    return known


@dataclass
class Run:
    """An encoded stretch of prepared text, with the numbers of tokens of its first and last piece."""

    real: str
    shadow: str
    ids: list[int]
    first: int
    last: int


class Codec:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str, leaf: int = LEAF_CHARS):
        self.bpe = load(path)
        self._ids = Remembered(lambda piece: tuple(encode_symbols(self.bpe.symbols(piece), self.bpe.merges)))
        self._leaf = leaf
        self._names = [self.bpe.names.get(i, "") for i in range(max(self.bpe.names) + 1)]
        #: Joins so far.
        self.joins = 0

    def run(self, real: str, shadow: str) -> Run:
        """A stretch of prepared text, encoded by halves and exact joins."""
        halves = 1
        while len(real) > self._leaf * halves:
            halves *= 2
        cuts = [len(real) * k // halves for k in range(halves + 1)]
        plain = shadow is real
        runs = []
        for a, b in zip(cuts, cuts[1:]):
            part = real[a:b]
            runs.append(self._leaf_run(part, part if plain else shadow[a:b]))
        return self.joined(runs)

    def _leaf_run(self, real: str, shadow: str) -> Run:
        pieces = split(real, shadow)
        if not pieces:
            return Run(real, shadow, [], 0, 0)
        look = self._ids.__getitem__
        ids = list(chain.from_iterable(map(look, pieces)))
        return Run(real, shadow, ids, len(look(pieces[0])), len(look(pieces[-1])))

    def joined(self, runs: list[Run]) -> Run:
        """Neighbouring runs joined level by level."""
        while len(runs) > 1:
            odd = runs[-1:] if len(runs) % 2 else []
            runs = [self.join(a, b) for a, b in zip(runs[::2], runs[1::2])] + odd
        return runs[0]

    def join(self, left: Run, right: Run) -> Run:
        """The encoding of the concatenation of two runs; left's ids are taken over."""
        self.joins += 1
        plain = left.shadow is left.real and right.shadow is right.real
        real = left.real + right.real
        shadow = real if plain else left.shadow + right.shadow
        if not left.ids or not right.ids:
            some = left if left.ids else right
            return Run(real, shadow, some.ids, some.first, some.last)
        def pieces(text: str, by: str, a: int, b: int) -> list[str]:
            part = text[a:b]
            return split(part, part if plain else by[a:b])

        cut, width = len(left.real), FIRST_CHARS
        while True:
            a, b = _space_before(left.shadow, cut - width), _space_after(right.shadow, width)
            new = pieces(real, shadow, a, cut + b)
            old, old_right = pieces(real, shadow, a, cut), pieces(right.real, right.shadow, 0, b)
            left_done = a == 0 or (len(old) > 1 and new[0] == old[0])
            right_done = b == len(right.real) or (len(old_right) > 1 and new[-1] == old_right[-1])
            if left_done and right_done:
                break
            width *= 2
        same = 0
        for x, y in zip(old, new):
            if x != y:
                break
            same += 1
        same_right = 0
        for x, y in zip(reversed(old_right), reversed(new[same:])):
            if x != y:
                break
            same_right += 1
        gone, gone_right = old[same:], old_right[: len(old_right) - same_right]
        fresh = new[same : len(new) - same_right]
        look = self._ids.__getitem__
        n = sum(len(look(p)) for p in gone[:-1]) + left.last if gone else 0
        n_right = right.first + sum(len(look(p)) for p in gone_right[1:]) if gone_right else 0
        if len(fresh) == len(gone) == len(gone_right) == 1 and len(fresh[0]) > LONG_PIECE:
            tokens = [join_runs(left.ids[-n:], right.ids[:n_right], self.bpe)]
        else:
            tokens = [look(p) for p in fresh]
        ids = left.ids
        if n:
            del ids[-n:]
        ids.extend(chain.from_iterable(tokens))
        ids += right.ids[n_right:] if n_right else right.ids
        first = left.first if a or same or not tokens else len(tokens[0])
        last = right.last if b < len(right.real) or same_right or not tokens else len(tokens[-1])
        return Run(real, shadow, ids, first, last)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        parts = self.bpe.parts(text)
        if len(parts) == 1:
            return self.run(*self.bpe.prepared(text)).ids if text else []
        out: list[int] = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.bpe.special[part])
            elif part:
                out += self.run(*self.bpe.prepared(part)).ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text that the library's decoder gives: token strings with one space between.

        Ids outside the vocabulary are skipped, as the library skips them.
        """
        names = self._names
        try:
            return " ".join(map(names.__getitem__, ids))
        except IndexError:
            return " ".join(names[i] for i in ids if i < len(names))


def _space_before(shadow: str, at: int) -> int:
    """The last space or line end up to ``at``, or the beginning."""
    return max(0, shadow.rfind(" ", 0, at + 1), shadow.rfind("\n", 0, at + 1)) if at > 0 else 0


def _space_after(shadow: str, at: int) -> int:
    """The first space or line end from ``at`` on, or the end."""
    found = [x for x in (shadow.find(" ", at), shadow.find("\n", at)) if x >= 0]
    return min(found, default=len(shadow))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The codec of a vocabulary file; a worker keeps it, with what it remembers, between tasks."""
    return Codec(path)


def encode(
    docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES
) -> DataFrame:
    """``(key, ids array<int>, decoded string, joins long)`` for every row of docs.

    ``ids`` are the token ids of the whole text; ``decoded`` is what decoding
    exactly those ids gives; ``joins`` is the number of joins that made them.
    """
    session_of(docs)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(column(key).alias("key"), column(text).alias("text"))
    long_text = F.coalesce(F.octet_length("text") > part_bytes, F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for part, texts in text_chunks(batches, 1):
            ids, joins = [], []
            for x in texts:
                before = own.joins
                ids.append(own.encode(x))
                joins.append(own.joins - before)
            yield _results(own, part.column(0), ids, joins)

    schema = f"key {kind}, ids array<int>, decoded string, joins long"
    short = rows.where(~long_text).mapInArrow(run, schema)
    out = short.unionByName(_encode_long(rows.where(long_text), vocabulary, kind, schema))
    return out.withColumnRenamed("key", key)


def _results(own: Codec, keys: pa.Array, ids: list[list[int]], joins: list[int]) -> pa.RecordBatch:
    decoded = [own.decode(x) for x in ids]
    return pa.RecordBatch.from_arrays(
        [keys, _int_lists(ids), pa.array(decoded, pa.string()), pa.array(joins, pa.int64())],
        ["key", "ids", "decoded", "joins"],
    )


def _int_lists(ids: list[list[int]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
    flat = np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _encode_long(rows: DataFrame, vocabulary: str, kind: str, schema: str) -> DataFrame:
    """Long texts: their parts are encoded by all tasks, then joined, text by text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every text's parts: bundles of short segments between special strings, and slices of long ones."""
        bpe = load(vocabulary)
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                name = hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()
                for n, (segment, strings) in enumerate(_parts(bpe, text)):
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(i, 1), pa.array([name], pa.binary()), pa.array([n], pa.int32()),
                            pa.array([segment], pa.int32()), pa.array([strings], pa.list_(pa.string())),
                        ],
                        ["key", "name", "part", "segment", "strings"],
                    )

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            for i in range(batch.num_rows):
                before, real = own.joins, None
                strings = batch.column(4)[i].as_py()
                if batch.column(3)[i].as_py() < 0:
                    special, ids = own.bpe.special, []
                    for k, x in enumerate(strings):
                        ids += [special[x]] if k % 2 else own.run(*_plain(own.bpe, x)).ids
                    first = last = 0
                else:
                    (real,) = strings
                    made = own.run(*_plain(own.bpe, real))
                    ids, first, last = made.ids, made.first, made.last
                yield pa.RecordBatch.from_arrays(
                    [
                        *(c.slice(i, 1) for c in batch.columns[:4]), batch.column(5).slice(i, 1),
                        pa.array([real], pa.string()), _int_lists([ids]), pa.array([first], pa.int32()),
                        pa.array([last], pa.int32()), pa.array([own.joins - before], pa.int64()),
                    ],
                    ["key", "name", "part", "segment", "copies", "real", "ids", "first", "last", "joins"],
                )

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            for i in range(batch.num_rows):
                ids, runs, joins, before = [], [], 0, own.joins
                parts = batch.column(1)[i].values
                field = {f: parts.field(f) for f in ("segment", "real", "ids", "first", "last", "joins")}
                segments = field["segment"].to_pylist()
                for k, segment in enumerate(segments):
                    own_ids = field["ids"][k].values.to_pylist()
                    joins += field["joins"][k].as_py()
                    if segment < 0:
                        ids += own_ids
                        continue
                    real = field["real"][k].as_py()
                    runs.append(Run(*_plain(own.bpe, real), own_ids, field["first"][k].as_py(), field["last"][k].as_py()))
                    if k + 1 == len(segments) or segments[k + 1] != segment:
                        ids += own.joined(runs).ids
                        runs = []
                out = _results(own, batch.column(0).slice(i, 1), [ids], [joins + own.joins - before])
                yield pa.RecordBatch.from_arrays([*out.columns, batch.column(2).slice(i, 1)], [*out.schema.names, "copies"])

    parts = rows.mapInArrow(
        cut, f"key {kind}, name binary, part int, segment int, strings array<string>"
    )
    # Equal rows meet here, already counted in the tasks that cut them; parts go wherever their hash leads.
    parts = parts.groupBy("key", "name", "part", "segment").agg(
        F.first("strings").alias("strings"), F.count("*").alias("copies")
    )
    done = parts.select("key", "name", "part", "segment", "strings", "copies").mapInArrow(
        encoded,
        f"key {kind}, name binary, part int, segment int, copies long, real string, ids array<int>, first int, last int, "
        "joins long",
    )
    texts = done.groupBy("key", "name").agg(
        F.array_sort(F.collect_list(F.struct("part", "segment", "real", "ids", "first", "last", "joins"))).alias("parts"),
        F.first("copies").alias("copies"),
    )
    joined = texts.select("key", "parts", "copies").mapInArrow(whole, f"{schema}, copies long")
    again = F.explode(F.sequence(F.lit(1).cast("long"), "copies"))
    return joined.withColumn("copy", again).drop("copy", "copies")


def _plain(bpe: WordBpe, real: str) -> tuple[str, str]:
    """A stretch of normalised text with the string that it is split by."""
    return real, bpe.shadow(real)


def _parts(bpe: WordBpe, text: str) -> Iterator[tuple[int, list[str]]]:
    """Parts of a text: ``(-1, bundle)``, text and special strings in turn, or ``(segment, [slice])``."""
    bundle, size = [], 0
    for k, part in enumerate(bpe.parts(text)):
        real = part if k % 2 else (bpe.prepared(part)[0] if part else "")
        if k % 2 == 0 and len(real) > PART_CHARS:
            if bundle:
                yield -1, bundle + [""] * (len(bundle) % 2 == 0)
            for at in range(0, len(real), PART_CHARS):
                yield k, [real[at : at + PART_CHARS]]
            bundle, size = [""], 0  # what follows is a special string
            continue
        bundle.append(real)
        size += len(real) + 1
        if size > PART_CHARS and k % 2 == 0:
            yield -1, bundle
            bundle, size = [""], 0
    if len(bundle) > 1 or bundle and bundle[0]:
        yield -1, bundle


def decode(
    encoded: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids"
) -> DataFrame:
    """``(key, decoded string)`` for every row of ids; null ids decode to the empty text."""
    session_of(encoded)
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            texts = [own.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string())], ["key", "decoded"]
            )

    out = encoded.select(key, ids).mapInArrow(run, f"key {kind}, decoded string")
    return out.withColumnRenamed("key", key)
