"""Quality rules: text statistics and a decision list learned from labels.

Statistics of whole texts are taken in Arrow batches with array arithmetic over
all words of a batch. A decision list is then learned by *sequential covering*
on the driver from a bounded sample of labelled statistics: each rule grows a
conjunction of thresholds on two thirds of the rows by information gain, is
pruned on the last third (on all rows where the third has too few bad ones), and takes the rows that it covers away before the next
one grows. The list is emitted as an ordered Spark conditional expression, so
applying it is a plain projection.

Edge cases: null and empty texts have no words and fail the base rule; an empty
table gives an empty table; rows that repeat are independent; without usable
labels (or with one class only) the list is empty and keeps what the base rule
keeps; null labels and null ids take no part in learning; other columns are not
looked at; a long text is gone through in slices, which takes some 40 bytes a word beside
the text; ties between equally good thresholds go to the earlier statistic and
the lower threshold.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, column, mix64, run_hashes, session_of, text_chunks, word_hashes
from .labelled import least_hashed

#: Characters that count as symbols (fixed by the result contract).
SYMBOLS = "#*$%&|<>"
#: Labelled rows that learning sees at most.
SAMPLE_ROWS = 20_000
#: Bad rows that the part kept back for pruning must hold to be used.
LEAST_HELD = 10
#: Thresholds tried for a statistic.
CUTS = 48

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_lines")
#: Ratios that rules may use besides the counts: name, numerator, denominator.
RATIOS = (
    ("symbols_per_char", "n_symbols", "word_chars"),
    ("upper_per_char", "n_upper", "word_chars"),
    ("marks_per_word", "n_marks", "n_words"),
    ("repeats_per_word", "n_repeat_words", "n_words"),
    ("chars_per_word", "word_chars", "n_words"),
    ("dup_lines_share", "n_dup_lines", "n_lines"),
)
FEATURES = (*COUNTS[:5], *(r[0] for r in RATIOS))

_U = np.uint64


#: Windows that are sorted at a time.
SORTED_WINDOWS = 2_000_000


def repeat_words(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per text: words within three-word windows that the text holds twice or more."""
    total = len(words)
    if total < 3:
        return np.zeros(len(counts), np.int64)
    odd = mix64(np.arange(11, 14, dtype=np.uint64)) | _U(1)
    windows = words[:-2] * odd[0]
    windows += words[1:-1] * odd[1]
    windows += words[2:] * odd[2]
    owner = inside = None
    if len(counts) > 1:
        owner = np.repeat(np.arange(len(counts)), counts)
        inside = owner[:-2] == owner[2:]
        windows = mix64(windows) + mix64(owner[:-2].astype(np.uint64) + _U(1 << 40))
    covered = np.zeros(total, bool)
    # Equal windows are in one part, so parts of a long text can be sorted one after the other.
    parts = 1 + total // SORTED_WINDOWS
    for part in range(parts):
        at = np.arange(len(windows)) if inside is None else np.flatnonzero(inside)
        if parts > 1:
            at = at[mix64(windows[at]) % _U(parts) == _U(part)]
        order = at[np.argsort(windows[at], kind="stable")]
        ordered = windows[order]
        same = ordered[1:] == ordered[:-1]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        starts = order[twice]
        for k in range(3):
            covered[starts + k] = True
    if owner is None:
        return np.array([np.count_nonzero(covered)], np.int64)
    return np.bincount(owner, covered, len(counts)).astype(np.int64)


_IS_LINE_END = np.zeros(256, bool)
_IS_LINE_END[0x0A] = True


def text_statistics(texts: list[str]) -> dict[str, np.ndarray]:
    """The COUNTS of some whole texts; one long text is gone through in slices."""
    raw = [x.encode("utf-8") for x in texts]
    long = len(raw) == 1 and len(raw[0]) > SLICE_BYTES
    if long:
        starts, _, words = run_hashes(raw[0])
        counts = np.array([len(words)], np.int64)
    else:
        words, counts = word_hashes(raw)
    out = {"n_words": counts.astype(np.int64), "n_repeat_words": repeat_words(words, counts)}
    spaces = [sum(r.count(c) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) for r in raw]
    out["word_chars"] = np.array([len(t) - s for t, s in zip(texts, spaces)], np.int64)
    symbols = [c.encode() for c in SYMBOLS]
    out["n_symbols"] = np.array([sum(map(r.count, symbols)) for r in raw], np.int64)
    if long:
        del words
        begins, ends, lines = run_hashes(raw[0], _IS_LINE_END)
        lines = lines[np.searchsorted(starts, begins) < np.searchsorted(starts, ends)]  # with a word
        out["n_lines"] = np.array([len(lines)], np.int64)
        out["n_dup_lines"] = np.array([len(lines) - len(np.unique(lines))], np.int64)
        out["n_upper"] = np.array([sum(raw[0].count(bytes([c])) for c in range(65, 91))], np.int64)
        out["n_marks"] = np.array([raw[0].count(b"!") + raw[0].count(b"?")], np.int64)
        return out
    lines = [[x for x in r.split(b"\n") if x.strip()] for r in raw]
    out["n_lines"] = np.array(list(map(len, lines)), np.int64)
    out["n_dup_lines"] = np.array([len(x) - len(set(x)) for x in lines], np.int64)
    joined = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.concatenate([[0], np.cumsum(list(map(len, raw)))]).astype(np.int64)
    for name, flags in (
        ("n_upper", (joined >= 65) & (joined <= 90)),
        ("n_marks", (joined == 33) | (joined == 63)),
    ):
        upto = np.concatenate([[0], np.cumsum(flags)])
        out[name] = upto[ends[1:]] - upto[ends[:-1]]
    return out


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, COUNTS...)`` for every row of docs."""
    session_of(docs)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches, 1):
            found = text_statistics(texts)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(found[c], pa.int64()) for c in COUNTS)], ["key", *COUNTS]
            )

    schema = ", ".join([f"key {kind}", *(f"{c} long" for c in COUNTS)])
    return docs.select(column(key), column(text)).mapInArrow(run, schema).withColumnRenamed("key", key)


def feature(name: str) -> Column:
    """A statistic or ratio as a double; a ratio with nothing below is 0."""
    for ratio, over, under in RATIOS:
        if ratio == name:
            return F.when(F.col(under) > 0, F.col(over) / F.col(under)).otherwise(F.lit(0.0))
    return F.col(name).cast("double")


@dataclass(frozen=True)
class Condition:
    """``feature >= cut`` or ``feature < cut``."""

    feature: str
    at_least: bool
    cut: float

    def holds(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        x = rows[self.feature]
        return x >= self.cut if self.at_least else x < self.cut

    def column(self) -> Column:
        x = feature(self.feature)
        return x >= self.cut if self.at_least else x < self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.cut:g}"


Rule = tuple[Condition, ...]


def _covers(rule: Sequence[Condition], rows: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for condition in rule:
        out &= condition.holds(rows)
    return out


def _grow(rows: dict[str, np.ndarray], bad: np.ndarray, longest: int) -> list[Condition]:
    """Add the threshold of highest gain until no good row is covered or none gains."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < longest:
        p, n = np.count_nonzero(bad & inside), np.count_nonzero(~bad & inside)
        if not p or not n:
            break
        base, best = np.log2(p / (p + n)), (1e-9, None)
        for name in FEATURES:
            x, y = rows[name][inside], bad[inside]
            cuts = np.unique(np.quantile(x, np.linspace(0, 1, CUTS + 2)[1:-1]))
            cuts = np.unique(np.concatenate([cuts, np.quantile(x[y], [0.01, 0.05, 0.25])]))
            order = np.argsort(x, kind="stable")
            below = np.searchsorted(x[order], cuts)
            upto = np.concatenate([[0], np.cumsum(y[order])])
            p_low, n_low = upto[below], below - upto[below]
            for at_least, ps, ns in ((True, p - p_low, n - n_low), (False, p_low, n_low)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(ps > 0, ps * (np.log2(ps / (ps + ns)) - base), -np.inf)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = gain[k], Condition(name, at_least, float(cuts[k]))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].holds(rows)
    return rule


def _prune(rule: list[Condition], rows: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, float]:
    """The prefix of a rule that is worth most on rows that it didn't grow on, and its precision there."""
    best, worth, precision = tuple(rule), -2.0, 0.0
    for k in range(1, len(rule) + 1):
        inside = _covers(rule[:k], rows, len(bad))
        p, n = np.count_nonzero(bad & inside), np.count_nonzero(~bad & inside)
        value = (p - n) / (p + n) if p + n else -1.0
        if value > worth:
            best, worth, precision = tuple(rule[:k]), value, p / (p + n) if p + n else 0.0
    return best, precision


def learn(
    rows: dict[str, np.ndarray],
    bad: np.ndarray,
    precision: float = 0.9,
    most_rules: int = 12,
    longest: int = 4,
    seed: int = 7,
) -> list[Rule]:
    """Rules whose rows are bad, in order; each held its precision on rows it didn't grow on."""
    rules: list[Rule] = []
    part = np.random.default_rng(seed).random(len(bad))
    left = np.ones(len(bad), bool)
    while len(rules) < most_rules and np.count_nonzero(bad & left) >= 2:
        grown_on, kept_back = left & (part < 2 / 3), left & (part >= 2 / 3)
        take = lambda m: {k: v[m] for k, v in rows.items()}
        if np.count_nonzero(bad & kept_back) < LEAST_HELD:  # too few to judge by: all rows that are left
            grown_on = kept_back = left
        rule = _grow(take(grown_on), bad[grown_on], longest)
        if not rule:
            break
        pruned, held = _prune(rule, take(kept_back), bad[kept_back])
        inside = _covers(pruned, rows, len(bad)) & left
        if held < precision or not np.count_nonzero(bad & inside):
            break
        rules.append(pruned)
        left &= ~inside
    return rules


def learn_from_labels(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample: int = SAMPLE_ROWS,
) -> list[Rule]:
    """A decision list from ``sample`` labelled rows at most (those of least id hash).

    Only the documents of those rows are measured for it.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    known = known.select(F.col(key), F.col(label).cast("int").alias("_label"))
    chosen = least_hashed(known, key, sample, "_label")
    marks: dict = {}
    for i, mark in chosen:
        marks.setdefault(i, []).append(mark)
    if not marks:
        return []
    # Bounded by the sample size.
    ids = docs.sparkSession.createDataFrame([(i,) for i in marks], known.select(key).schema)
    stats = statistics(docs.join(F.broadcast(ids), key, "left_semi"), key, text)
    # Ids may repeat in docs: as many rows as labels at most, by least hash.
    order = [F.xxhash64(key), F.col(key), *map(F.col, COUNTS)]
    stats = stats.orderBy(*order).limit(sample)
    got = stats.select(F.col(key).alias("id"), *(feature(f).alias(f) for f in FEATURES)).toPandas()
    got = got.sort_values(["id", *FEATURES], kind="stable")
    bad, at = [], []
    for row, i in enumerate(got["id"]):
        for mark in marks[i]:
            at.append(row)
            bad.append(mark == 0)
    rows = {f: got[f].to_numpy(float)[at] for f in FEATURES}
    return learn(rows, np.array(bad, bool)) if at else []


def verdict(rules: Sequence[Rule]) -> Column:
    """The decision list as an ordered conditional expression: false where a rule holds."""
    out = None
    for rule in rules:
        holds = rule[0].column()
        for condition in rule[1:]:
            holds = holds & condition.column()
        out = F.when(holds, F.lit(False)) if out is None else out.when(holds, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed() -> Column:
    """The fixed base rule: too few words, or more than half of them in repeated windows."""
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def accepted_documents(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    learn_on: DataFrame | None = None,
) -> DataFrame:
    """The rows of docs, with all their columns, that the learned list keeps; the base rule isn't applied.

    The list is learned on the labelled rows of ``learn_on`` (docs where it is
    None): an earlier filter may have left docs without bad rows to learn from.
    Statistics travel beside the row, so nothing is shuffled.
    """
    session_of(docs)
    rules = learn_from_labels(docs if learn_on is None else learn_on, labels, key, text, label)
    # Numbered, since names may hold dots.
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    packed = plain.select(F.struct(*plain.columns).alias("row"), F.col(f"c{docs.columns.index(text)}").alias("text"))
    kind = packed.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches, 1):
            found = text_statistics(texts)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(found[c], pa.int64()) for c in COUNTS)], ["row", *COUNTS]
            )

    schema = ", ".join([f"row {kind}", *(f"{c} long" for c in COUNTS)])
    return packed.mapInArrow(run, schema).where(verdict(rules)).select("row.*").toDF(*docs.columns)


def quality_rules(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality"
) -> DataFrame:
    """``(key, counts, base_failed, kept)`` for every row of docs."""
    rules = learn_from_labels(docs, labels, key, text, label)
    flagged = statistics(docs, key, text).withColumn("base_failed", base_failed())
    return flagged.select(
        key, *COUNTS[:5], "base_failed", (~F.col("base_failed") & verdict(rules)).alias("kept")
    )
