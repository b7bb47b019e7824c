"""Quality by attention-based multiple-instance learning.

A text is a bag of passages of ``PASSAGE_WORDS`` words. Every passage is encoded:
shares of byte classes, word-shape statistics and hashed byte pairs, standardised
and passed through a learned hidden layer. A gated attention unit
``softmax_k(w . (tanh(V h_k) * sigmoid(U h_k)))`` weighs the passages, learned
from document labels alone; the document is the weighted sum of its passage
representations, and a linear unit with a logistic gives its score.

Training is on the driver from a bounded sample of labelled documents (see
:mod:`.labelled`); scoring runs in Arrow batches over whole texts. Long texts are encoded
in slices that end between passages, so besides the text and its word positions
(24 bytes a word) memory is bounded by the slice.

Edge cases: null and empty texts have one passage without features and get its
score; an empty table gives an empty table; without usable labels, or with one
class only, every score is the share of label 1 (0.5 without labels); null
labels and ids take no part in learning; repeated rows are independent; other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, column, fold, mix64, run_hashes, session_of, text_chunks, word_hashes
from .labelled import labelled_texts

#: Words in a passage.
PASSAGE_WORDS = 64
#: Buckets for hashed byte pairs.
PAIR_BUCKETS = 32
#: Units of the hidden layer and of the attention.
HIDDEN, ATTENTION = 24, 12
#: Labelled documents that learning sees at most.
SAMPLE_DOCS = 4_000

_U = np.uint64

#: Byte classes: their order is fixed by this list; what is left is "other".
_CLASSES = [
    range(ord("a"), ord("z") + 1), range(ord("A"), ord("Z") + 1), range(ord("0"), ord("9") + 1),
    b" ", b"\n", b".", b",", b"!?", b"#*$%&|<>", b";:'\"()-", b"@/\\_=+~^`[]{}", range(0x80, 0x100),
]
_CLASS_OF = np.full(256, len(_CLASSES), np.uint8)
for _k, _members in enumerate(_CLASSES):
    _CLASS_OF[list(_members)] = _k
_N_CLASSES = len(_CLASSES) + 1
_SHAPE = 5
N_FEATURES = _N_CLASSES + PAIR_BUCKETS + _SHAPE
_PAIR_BUCKET = (
    mix64(np.arange(1 << 16, dtype=np.uint64) + _U(0x51ED270B)) >> _U(64 - PAIR_BUCKETS.bit_length() + 1)
).astype(np.uint8)


def encode_passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of all texts in order, and each text's number of passages (1 at least)."""
    raw = [x.encode("utf-8") for x in texts]
    if len(raw) > 1 or sum(map(len, raw)) <= SLICE_BYTES:
        return _encode(raw)
    # One long text: slices of whole passages, each from the first byte of its first word.
    starts = run_hashes(raw[0])[0]
    n_words, firsts = len(starts), starts[::PASSAGE_WORDS].copy()
    del starts
    firsts[:1] = 0
    parts, at = [], 0
    while at < max(1, len(firsts)):
        begin = int(firsts[at]) if len(firsts) else 0
        end = max(at + 1, int(np.searchsorted(firsts, begin + SLICE_BYTES)))
        stop = int(firsts[end]) if end < len(firsts) else len(raw[0])
        follow = raw[0][stop : stop + 1] if stop < len(raw[0]) else None
        slice_ = raw[0][begin:stop]
        one = end == at + 1 and len(slice_) > 2 * SLICE_BYTES
        parts.append(_encode_wide(slice_, n_words, follow) if one else _encode([slice_], n_words, follow)[0])
        at = end
    features = np.concatenate(parts)
    return features, np.array([len(features)], np.int64)


def _encode_wide(raw: bytes, in_text: int, follow: bytes | None) -> np.ndarray:
    """_encode for one passage of very long words, a stretch of bytes after the other."""
    kind, pairs = np.zeros(_N_CLASSES, np.int64), np.zeros(PAIR_BUCKETS, np.int64)
    for at in range(0, len(raw), SLICE_BYTES):
        after = raw[at + SLICE_BYTES : at + SLICE_BYTES + 1] or follow or b" "
        part = np.frombuffer(raw[at : at + SLICE_BYTES] + after, np.uint8)
        kind += np.bincount(_CLASS_OF[part[:-1]], minlength=_N_CLASSES)
        pairs += np.bincount(_PAIR_BUCKET[part[:-1].astype(np.int32) << 8 | part[1:]], minlength=PAIR_BUCKETS)
    kind[3] += follow is None  # the blank that ends a text
    words = run_hashes(raw)[2]
    two = mix64(words[:-1] * _U(3) + words[1:])
    n_bytes, some = max(int(kind.sum()), 1), max(len(words), 1)
    shape = [
        np.log1p(len(words)), (n_bytes - kind[3] - kind[4]) / some, 1 - len(np.unique(words)) / some,
        1 - len(np.unique(two)) / max(len(two), 1), np.log1p(in_text),
    ]
    return np.concatenate([kind / n_bytes, pairs / n_bytes, shape]).astype(np.float32)[None, :]


def _encode(raw: list[bytes], in_text: int | None = None, follow: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """encode_passages for texts, or for a slice of a text of ``in_text`` words that ``follow`` comes after."""
    sizes = np.array([len(x) + 1 for x in raw], np.int64)
    joined = np.frombuffer(b" ".join(raw) + (follow or b" "), np.uint8)
    words, counts = word_hashes(raw)
    passages = np.maximum(1, -(-counts // PASSAGE_WORDS))
    first = np.cumsum(passages) - passages
    total = int(passages.sum())

    # The passage of every word, and of every byte: that of the last word begun.
    owner = np.repeat(np.arange(len(raw)), counts)
    nth_word = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    word_at = first[owner] + nth_word // PASSAGE_WORDS
    space = (joined == 0x20) | ((joined >= 0x09) & (joined <= 0x0D))
    begins = ~space & np.concatenate([[True], space[:-1]])
    begun = np.cumsum(begins, dtype=np.int64)
    text_of = np.repeat(np.arange(len(raw)), sizes)
    before = np.cumsum(counts) - counts
    nth = np.clip(begun - 1 - before[text_of], 0, np.maximum(counts[text_of] - 1, 0))
    byte_at = first[text_of] + nth // PASSAGE_WORDS

    kind = byte_at * _N_CLASSES + _CLASS_OF[joined]
    kind = np.bincount(kind if follow is None else kind[:-1], minlength=total * _N_CLASSES)
    kind = kind.reshape(total, _N_CLASSES)
    pair = _PAIR_BUCKET[joined[:-1].astype(np.int32) << 8 | joined[1:]]
    within = np.ones(len(joined), bool)
    within[np.cumsum(sizes) - 1] = False  # a pair that would span two texts
    within = within[:-1]
    pairs = np.bincount((byte_at[:-1] * PAIR_BUCKETS + pair)[within], minlength=total * PAIR_BUCKETS)
    pairs = pairs.reshape(total, PAIR_BUCKETS)
    n_bytes = np.maximum(kind.sum(axis=1), 1)
    n_words = np.bincount(word_at, minlength=total)

    # Repeats within a passage: words and word pairs met before in it.
    def fresh(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        keyed = values + mix64(at.astype(np.uint64) + _U(1))
        _, index = np.unique(keyed, return_index=True)
        return np.bincount(at[index], minlength=total)

    inside = word_at[1:] == word_at[:-1]
    two = mix64(words[:-1] * _U(3) + words[1:])[inside]
    n_two = np.bincount(word_at[1:][inside], minlength=total)
    some = np.maximum(n_words, 1)
    shape = np.stack(
        [
            np.log1p(n_words),
            (n_bytes - kind[:, 3] - kind[:, 4]) / some,
            1 - fresh(words, word_at) / some,
            1 - fresh(two, word_at[1:][inside]) / np.maximum(n_two, 1),
            np.log1p(np.repeat(counts if in_text is None else np.array([in_text]), passages)),
        ],
        axis=1,
    )
    out = np.concatenate([kind / n_bytes[:, None], pairs / n_bytes[:, None], shape], axis=1)
    return out.astype(np.float32), passages


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Standardisation and the weights by name."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, features: np.ndarray, passages: np.ndarray) -> dict[str, np.ndarray]:
        """All intermediate values for some bags (passages of one bag are consecutive)."""
        w = self.weights
        x = np.clip((features - self.mean) / self.scale, -8, 8)
        starts = np.cumsum(passages) - passages
        bag = np.repeat(np.arange(len(passages)), passages)
        h = np.tanh(x @ w["W"] + w["b"])
        gate, value = _sigmoid(h @ w["U"]), np.tanh(h @ w["V"])
        energy = (gate * value) @ w["a"]
        energy = np.exp(energy - np.maximum.reduceat(energy, starts)[bag])
        attention = energy / np.add.reduceat(energy, starts)[bag]
        z = np.add.reduceat(attention[:, None] * h, starts)
        score = _sigmoid(z @ w["c"] + w["d"])
        return dict(x=x, bag=bag, starts=starts, h=h, gate=gate, value=value, attention=attention, z=z, score=score)

    def gradients(self, passed: dict[str, np.ndarray], slack: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the loss, given its derivative by each bag's logit."""
        w, p, bag = self.weights, passed, passed["bag"]
        out = {"c": p["z"].T @ slack, "d": slack.sum(keepdims=True)}
        dz = slack[:, None] * w["c"][None, :]
        da = (dz[bag] * p["h"]).sum(axis=1)
        mean = np.add.reduceat(p["attention"] * da, p["starts"])
        de = p["attention"] * (da - mean[bag])
        out["a"] = (p["gate"] * p["value"]).T @ de
        both = de[:, None] * w["a"][None, :]
        dv = both * p["gate"] * (1 - p["value"] ** 2)
        du = both * p["value"] * p["gate"] * (1 - p["gate"])
        out["V"], out["U"] = p["h"].T @ dv, p["h"].T @ du
        dh = p["attention"][:, None] * dz[bag] + dv @ w["V"].T + du @ w["U"].T
        dx = dh * (1 - p["h"] ** 2)
        out["W"], out["b"] = p["x"].T @ dx, dx.sum(axis=0)
        return out


def train(
    features: np.ndarray, passages: np.ndarray, good: np.ndarray, epochs: int = 24, batch: int = 128, seed: int = 3
) -> Model:
    """Fit the network to document labels with Adam; classes weigh the same."""
    rng = np.random.default_rng(seed)
    good = np.asarray(good, float)
    share = float(good.mean()) if len(good) else 0.5
    init = lambda *s: rng.normal(0, s[0] ** -0.5, s).astype(np.float32)
    weights = {
        "W": init(N_FEATURES, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "U": init(HIDDEN, ATTENTION),
        "V": init(HIDDEN, ATTENTION), "a": init(ATTENTION), "c": init(HIDDEN), "d": np.zeros(1, np.float32),
    }
    if not len(good) or share in (0.0, 1.0):
        weights["c"][:] = 0
        weights["d"][:] = np.log((share + 1e-6) / (1 - share + 1e-6))
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), weights)
    model = Model(features.mean(axis=0), features.std(axis=0) + 1e-3, weights)
    starts = np.cumsum(passages) - passages
    balance = np.where(good > 0, 0.5 / share, 0.5 / (1 - share))
    first = {k: np.zeros_like(v) for k, v in weights.items()}
    second = {k: np.zeros_like(v) for k, v in weights.items()}
    t, steps = 0, epochs * -(-len(good) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(good))
        for at in range(0, len(order), batch):
            t += 1
            own = order[at : at + batch]
            rows = np.concatenate([np.arange(starts[i], starts[i] + passages[i]) for i in own])
            passed = model.forward(features[rows], passages[own])
            slack = balance[own] * (passed["score"] - good[own]) / len(own)
            rate = 0.01 * (1 - t / (steps + 1))
            for k, g in model.gradients(passed, slack).items():
                g = g + 1e-4 * weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                step = (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
                weights[k] = (weights[k] - rate * step).astype(np.float32)
    return model


def fit(
    docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, held: tuple[int, int], sample: int
) -> Model:
    """A model from ``sample`` labelled documents at most, outside the held-out fold."""
    texts, good, _ = labelled_texts(docs, labels, label, held, sample, key, text)
    parts = [encode_passages(texts[at : at + 200]) for at in range(0, len(texts), 200)]
    if not parts:
        return train(np.empty((0, N_FEATURES), np.float32), np.empty(0, np.int64), good)
    features, passages = (np.concatenate(x) for x in zip(*parts))
    return train(features, passages, good)


def _scores(model: Model, texts: list[str]) -> np.ndarray:
    return model.forward(*encode_passages(texts))["score"].astype(np.float64)


def quality(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.5,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    held: tuple[int, int] = (3, 1),
    sample: int = SAMPLE_DOCS,
) -> DataFrame:
    """``(key, held_out, score, predicted)`` for every row of docs.

    Labels of rows whose id falls into fold ``held[1]`` of ``held[0]`` are not used.
    """
    session_of(docs)
    model = fit(docs, labels, key, text, label, held, sample)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_scores(model, texts))], ["key", "score"])

    out = docs.select(column(key), column(text)).mapInArrow(run, f"key {kind}, score double")
    return out.withColumnRenamed("key", key).select(
        key,
        (fold(key, held[0]) == held[1]).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def good_documents(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.5,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    held: tuple[int, int] = (3, 1),
    sample: int = SAMPLE_DOCS,
) -> DataFrame:
    """The rows of docs, with all their columns, that score the threshold or more. Nothing is shuffled."""
    session_of(docs)
    model = fit(docs, labels, key, text, label, held, sample)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches, at):
            yield part.filter(pa.array(_scores(model, texts) >= threshold))

    # Numbered, since names may hold dots.
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
