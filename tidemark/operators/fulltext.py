"""Stemmed full text, ranked by how closely the words of a query lie together (cover density).

Stems are those of Porter's published suffix-stripping algorithm, as a chain of rewriting steps on a
column. A *cover* is a stretch of a text that holds all stems of the query and none of whose parts does. A
text scores 0.1 for each cover (the weight of unlabelled words), divided by one more than the number of other
words in it. Stop words take part in places but aren't searched for.

Texts are split once. Of their words only those are stemmed that begin like a stem of the query, and of those
only hits become rows; a window over a text's hits finds, for each hit, the last place of every
stem up to there: the least of them begins a cover if it differs from the one at the hit before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.functions.spans import bound
from tidemark.operators.lexical import query_tokens
from tidemark.sources.tables import spread

# The conditions of the published algorithm, as patterns: consonants and vowels in turn
# (y is a vowel after a consonant), measure over 0, of 1, over 1, a vowel, consonant-vowel-consonant at the end.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_OVER_0 = f"^(?:{_C})?{_V}{_C}"
_IS_1 = f"^(?:{_C})?{_V}{_C}(?:{_V})?$"
_OVER_1 = f"^(?:{_C})?{_V}{_C}{_V}{_C}"
_VOWEL = f"^(?:{_C})?[aeiouy]"
_SHORT = f"^{_C}[aeiouy][^aeiouwxy]$"

# Suffixes of steps 2 to 4 and what stands for them.
_STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
)
_STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)


def _cut(word: Column, suffix: str) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - len(suffix))


def _first(word: Column, *cases: tuple[Column, Column]) -> Column:
    """What the first case that applies makes of a word."""
    out = None
    for condition, value in cases:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(word)


def _plurals(w: Column) -> Column:
    return _first(
        w, (w.endswith("sses") | w.endswith("ies"), _cut(w, "es")), (w.endswith("ss"), w), (w.endswith("s"), _cut(w, "s"))
    )


def _endings(w: Column) -> Column:
    def repaired(x: Column) -> Column:
        doubled = x.rlike(r"([^aeiouylsz])\1$")
        return _first(
            x, (x.rlike("(at|bl|iz)$"), F.concat(x, F.lit("e"))), (doubled, _cut(x, "x")), (x.rlike(_SHORT), F.concat(x, F.lit("e")))
        )

    eed = w.endswith("eed")
    ed, ing = _cut(w, "ed"), _cut(w, "ing")
    return _first(
        w,
        (eed & _cut(w, "eed").rlike(_OVER_0), _cut(w, "d")),
        (eed, w),
        (w.endswith("ed") & ed.rlike(_VOWEL), bound(ed, repaired)),
        (w.endswith("ing") & ing.rlike(_VOWEL), bound(ing, repaired)),
    )


def _y(w: Column) -> Column:
    return _first(w, (w.endswith("y") & _cut(w, "y").rlike(_VOWEL), F.concat(_cut(w, "y"), F.lit("i"))))


def _swaps(pairs: Sequence[tuple[str, str]]):
    """The step that replaces the longest of some suffixes, where the measure of what is before it is over 0."""
    longest = sorted(pairs, key=lambda p: -len(p[0]))

    def step(w: Column) -> Column:
        cases = [(w.endswith(s), F.when(_cut(w, s).rlike(_OVER_0), F.concat(_cut(w, s), F.lit(to))).otherwise(w)) for s, to in longest]
        return _first(w, *cases)

    return step


def _drops(w: Column) -> Column:
    cases = []
    for s in sorted((*_STEP_4, "ion"), key=lambda s: -len(s)):
        rest = _cut(w, s)
        good = rest.rlike(_OVER_1) & (rest.rlike("[st]$") if s == "ion" else F.lit(True))
        cases.append((w.endswith(s), F.when(good, rest).otherwise(w)))
    return _first(w, *cases)


def _last_e(w: Column) -> Column:
    rest = _cut(w, "e")
    return _first(w, (w.endswith("e") & (rest.rlike(_OVER_1) | (rest.rlike(_IS_1) & ~rest.rlike(_SHORT))), rest))


def _last_l(w: Column) -> Column:
    return _first(w, (w.endswith("ll") & _cut(w, "l").rlike(_OVER_1), _cut(w, "l")))


def stem(word: Column) -> Column:
    """The stem of a lower-case word; words of two letters are their own."""

    def stemmed(w: Column, steps: Sequence) -> Column:
        return w if not steps else bound(steps[0](w), lambda x: stemmed(x, steps[1:]))

    steps = (_plurals, _endings, _y, _swaps(_STEP_2), _swaps(_STEP_3), _drops, _last_e, _last_l)
    return bound(word, lambda w: F.when(F.length(w) <= 2, w).otherwise(stemmed(w, steps)))


def query_stems(spark: SparkSession, query: Sequence[str]) -> list[str]:
    """The distinct stems of a query's words without stop words (of all where nothing else is left)."""
    rows = spark.createDataFrame([(w,) for w in query_tokens(" ".join(query))], "w string")
    return sorted({r[0] for r in rows.select(stem(F.col("w"))).collect()})


def cover_density(docs: DataFrame, query: Sequence[str], key: str, column: str) -> DataFrame:
    """``(key, rank, covers)`` of the texts that hold the stems of all words of a query. Keys are unique."""
    stems = query_stems(docs.sparkSession, query)
    # A stem keeps the beginning of its word but for a final y, which becomes i.
    heads = sorted({s[: max(1, min(3, len(s) - 1))] for s in stems})
    likely = lambda w: F.exists(F.array(*map(F.lit, heads)), lambda h: F.startswith(w, h))
    words = text.terms(F.coalesce(F.col(column), F.lit("")))
    near = bound(words, lambda t: F.filter(F.transform(t, lambda w, i: F.struct(i.alias("pos"), w.alias("w"))), lambda x: likely(x["w"])))
    rows = spread(docs.select(key, column)).select(key, F.inline(near)).withColumn("stem", stem(F.col("w")))
    hits = rows.where(F.col("stem").isin(*stems)).select(key, "pos", "stem")
    order = Window.partitionBy(key).orderBy("pos")
    numbered = hits.withColumn("nth", F.row_number().over(order))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = F.struct("pos", "nth")
    last = [F.last(F.when(F.col("stem") == s, place), ignorenulls=True).over(upto).alias(f"l{i}") for i, s in enumerate(stems)]
    seen = numbered.select(key, "pos", "nth", *last)
    whole = seen.where(" and ".join(f"l{i} is not null" for i in range(len(stems))))
    begin = F.least(*(F.col(f"l{i}") for i in range(len(stems)))) if len(stems) > 1 else F.col("l0")
    found = whole.select(key, "pos", "nth", begin.alias("begin"))
    before = F.lag("begin.pos").over(order)
    covers = found.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col("begin.pos")))
    noise = (F.col("pos") - F.col("begin.pos")) - (F.col("nth") - F.col("begin.nth"))
    return covers.groupBy(key).agg(F.sum(F.lit(0.1) / (1 + noise)).alias("rank"), F.count("*").alias("covers"))
