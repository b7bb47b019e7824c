"""Toxicity by a character n-gram linear classifier with naive Bayes scaled features.

Features are the character n-grams of the distinct lower-cased words of a text,
each word between boundary marks; an n-gram's value in a text is whether it
occurs. From bounded labelled text, each n-gram gets the log ratio of its
smoothed shares of toxic and other documents, and a logistic regression on the
scaled values gets weights. A score is the logistic of the weighted sum, so each
n-gram contributes ``ratio * weight``.

N-grams are hashed to a fixed table. The sum over a text's distinct n-grams is
over all of its words: a worker remembers the n-gram slots of short words. Long texts are
taken in slices and very long words in stretches that overlap, so memory beside
the text is bounded.

Edge cases: null and empty texts get the score of no features; an empty table
gives an empty table; without usable labels, or with one class only, every score
is the share of toxic labels (0 without labels); null labels and ids take no
part in learning; repeated rows are independent; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, fold, mix64, session_of, text_chunks
from .labelled import labelled_texts

#: Labelled documents that learning sees at most.
SAMPLE_DOCS = 4_000
#: Lengths of the n-grams, and bits of the table that they are hashed to.
NGRAMS, TABLE_BITS = (3, 4, 5, 6), 20
#: Documents that must hold an n-gram for it to count.
LEAST_DOCS = 5


#: Characters that are no part of a word at its ends.
PUNCTUATION = ".,;:!?\"'()[]{}#*$%&|<>-_"

_U = np.uint64
#: Words that a worker remembers, and characters in one of them at most.
_CACHE_WORDS, _CACHE_CHARS = 200_000, 48
#: Characters of a text, and of words, that are worked on at a time.
_SLICE_CHARS, _SLOT_CHARS = 1_000_000, 200_000
_space = re.compile(r"\s").search


def word_slots(words: list[str], live: np.ndarray | None = None) -> list[tuple[int, ...]]:
    """Table slots of each word's n-grams; with live (a flag for each slot), only those."""
    marked = [f"<{w.strip(PUNCTUATION)}>" for w in words]
    out: list[tuple[int, ...]] = []
    at = 0
    while at < len(marked):
        if len(marked[at]) > _SLOT_CHARS:
            # A very long word: its n-grams are those of stretches that overlap.
            long = marked[at]
            parts = (long[i : i + _SLOT_CHARS + max(NGRAMS) - 1] for i in range(0, len(long), _SLOT_CHARS))
            out.append(tuple(set().union(*(_slots([x], live)[0] for x in parts))))
            at += 1
            continue
        upto, chars = at, 0
        while upto < len(marked) and chars + len(marked[upto]) <= _SLOT_CHARS:
            chars += len(marked[upto])
            upto += 1
        out += _slots(marked[at:upto], live)
        at = upto
    return out


def _slots(marked: list[str], live: np.ndarray | None) -> list[tuple[int, ...]]:
    """Slots of the n-grams of some strings, taken as they are."""
    sizes = np.array(list(map(len, marked)), np.int64)
    joined = "".join(marked).encode("utf-32-le", "surrogatepass")
    total = len(joined) // 4
    letters = np.zeros(total + max(NGRAMS), np.uint64)
    letters[:total] = np.frombuffer(joined, np.uint32)
    ends = np.repeat(np.cumsum(sizes), sizes)
    owner = np.repeat(np.arange(len(marked)), sizes)
    value = np.zeros(total, np.uint64)
    owners, slots = [], []
    for n in range(1, max(NGRAMS) + 1):
        value = value * _U(0x9E3779B97F4A7C15) + letters[n - 1 : n - 1 + total]
        if n not in NGRAMS:
            continue
        slot = (mix64(value + _U(n)) >> _U(64 - TABLE_BITS)).astype(np.int64)
        inside = np.arange(n, total + n) <= ends
        if live is not None:
            inside &= live[slot]
        owners.append(owner[inside])
        slots.append(slot[inside])
    owner, slot = np.concatenate(owners), np.concatenate(slots)
    order = np.argsort(owner, kind="stable")
    slot = slot[order].tolist()
    bounds = np.searchsorted(owner[order], np.arange(len(marked) + 1)).tolist()
    return [tuple(slot[i:j]) if j > i else () for i, j in zip(bounds, bounds[1:])]


class Slots:
    """The distinct n-gram slots of texts; slots of short words seen before are remembered."""

    def __init__(self, live: np.ndarray | None = None):
        self.live = live
        self.known: dict[str, tuple[int, ...]] = {}

    def of(self, texts: list[str]) -> list[set[int]]:
        """For each text the set of its slots; a long text is taken in slices that end between words."""
        if len(texts) == 1 and len(texts[0]) > _SLICE_CHARS:
            text, found, at = texts[0], set(), 0
            while at < len(text):
                gap = _space(text, at + _SLICE_CHARS)
                end = gap.start() if gap else len(text)
                found |= self._of([text[at:end]])[0]
                at = end
            return [found]
        return self._of(texts)

    def _of(self, texts: list[str]) -> list[set[int]]:
        words = [set(t.lower().split()) for t in texts]
        if len(self.known) > _CACHE_WORDS:
            self.known = {}
        new = list(set().union(*words) - self.known.keys())
        slots = dict(zip(new, word_slots(new, self.live)))
        self.known.update((w, x) for w, x in slots.items() if len(w) <= _CACHE_CHARS)
        known = self.known
        return [set().union(*(known[w] if w in known else slots[w] for w in own)) for own in words]


@dataclass
class Model:
    """Weights of table slots (ratio times weight) and the intercept."""

    slots: np.ndarray
    weights: np.ndarray
    bias: float

    def scorer(self):
        """A function from texts to scores."""
        table = np.zeros(1 << TABLE_BITS)
        table[self.slots] = self.weights
        live = np.zeros(1 << TABLE_BITS, bool)
        live[self.slots] = True
        slots = Slots(live)

        def score(texts: list[str]) -> np.ndarray:
            out = np.full(len(texts), self.bias)
            for i, present in enumerate(slots.of(texts)):
                if present:
                    # Sorted, so that the sum doesn't depend on the order of the set.
                    out[i] += table[np.sort(np.fromiter(present, np.int64, len(present)))].sum()
            return 1 / (1 + np.exp(-np.clip(out, -30, 30)))

        return score


def train(texts: list[str], toxic: np.ndarray, rounds: int = 150, l2: float = 2.0) -> Model:
    """Fit ratios and weights; texts are whole."""
    toxic = np.asarray(toxic, float)
    empty = np.empty(0, np.int64)
    if not len(toxic) or toxic.min() == toxic.max():
        share = float(toxic.mean()) if len(toxic) else 0.0
        return Model(empty, np.empty(0), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    all_slots, size = Slots(), 1 << TABLE_BITS
    p, q = np.zeros(size), np.zeros(size)
    docs = []
    for at in range(0, len(texts), 64):
        for found, bad in zip(all_slots.of(texts[at : at + 64]), toxic[at : at + 64]):
            docs.append(np.sort(np.fromiter(found, np.int32, len(found))))
            (p if bad else q)[docs[-1]] += 1  # slots of one text are distinct
    del all_slots
    used = np.flatnonzero(p + q >= LEAST_DOCS)
    ratio = np.log((p[used] + 1) / (toxic.sum() + 2)) - np.log((q[used] + 1) / ((1 - toxic).sum() + 2))
    # Slots whose ratio is noise add noise over long texts: keep those that stand out.
    error = np.sqrt(1 / (p[used] + 1) + 1 / (q[used] + 1))
    keep = np.abs(ratio) > 2.5 * error
    used, ratio = used[keep], ratio[keep]
    place = np.full(size, -1, np.int32)
    place[used] = np.arange(len(used))
    # Only slots that are kept go on, text by text.
    cols = [c[c >= 0] for c in (place[d] for d in docs)]
    del docs
    row = np.repeat(np.arange(len(cols)), list(map(len, cols)))
    col = np.concatenate(cols).astype(np.int64)
    del cols
    value = ratio[col]
    weights, bias = np.zeros(len(used)), float(np.log(toxic.mean() / (1 - toxic.mean())))
    n = len(toxic)
    balance = np.where(toxic > 0, 0.5 / toxic.mean(), 0.5 / (1 - toxic.mean()))
    m = v = np.zeros(len(used) + 1)
    for t in range(1, rounds + 1):
        z = bias + np.bincount(row, value * weights[col], n)
        slack = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic)
        grad = np.bincount(col, value * slack[row], len(used)) + l2 * weights
        full = np.append(grad, slack.sum()) / n
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full**2
        step = 0.04 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        weights, bias = weights - step[:-1], bias - step[-1]
    return Model(used, ratio * weights, float(bias))


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.3,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    held: tuple[int, int] = (4, 2),
    sample: int = SAMPLE_DOCS,
) -> DataFrame:
    """``(key, held_out, score, predicted)`` for every row of docs.

    Labels of rows whose id falls into fold ``held[1]`` of ``held[0]`` are not used.
    """
    session_of(docs)
    texts, toxic, _ = labelled_texts(docs, labels, label, held, sample, key, text)
    model = train(texts, toxic)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for part, texts in text_chunks(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score(texts))], ["key", "score"])

    out = docs.select(column(key), column(text)).mapInArrow(run, f"key {kind}, score double")
    return out.withColumnRenamed("key", key).select(
        key,
        (fold(key, held[0]) == held[1]).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
