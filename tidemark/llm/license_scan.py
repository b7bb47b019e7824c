"""Licence notices by the Dice coefficient over word bigrams. DataFrame functions only.

A text is lower-cased and everything but letters and digits becomes a space. Windows
of its word bigrams are compared with those of licence templates (sentences, headers
and whole licence texts): ``2 * |A & B| / (|A| + |B|)`` of the distinct bigrams. A
window may begin in mid-line and go over many lines.

Bounds that can't lose a match come first. A text must hold one of a template's *anchor*
words, those without which too few of the template's bigrams are left to reach the
threshold t. A window of the highest coefficient begins and ends with a bigram of its
template, for one that doesn't can be cut there. With n bigrams in a template a window
has at most ``(2 - t) / t * n`` bigrams, and at least ``t / (2 - t) * n`` of them are the
template's; so a template whose bigrams don't lie that close together anywhere is not
compared at all.

Of each template the best window counts: the highest coefficient, then the shorter one,
then the earlier one. Where the best windows of two templates overlap, the better one
counts (then that of the earlier template).

The template's bigrams are one hash table, a literal of the plan: a bucket for each remainder of
``xxhash64``, so finding a bigram takes one look-up however many templates there are, and
there is no join and no shuffle. Each beginning of a window takes one pass over the
next ``most`` bigrams, with running counts of distinct and of shared ones: a bigram is new in
the window if its last occurrence lies before the beginning. A window ends with a bigram that is
new, for one that isn't can be cut. Beginnings are passed over from which too few of the template's
bigrams are near enough to beat the best window so far, or which follow on one that the window
could gain. Templates come from a table of ``(name, text)`` rows, or from
:mod:`.license_texts`; the list's bigrams are held by every task.

Edge cases: null and empty texts and texts without a notice give no matches and
null licence columns; texts of fewer than two words have no bigrams and match
nothing; repeated rows are independent; an empty table gives an empty table; other
columns are not looked at. A text with an anchor is held as its bigrams, about ten times its
size; one megabyte of notices takes seconds (a test holds the number of windows down).
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from math import ceil
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column
from .license_texts import TEMPLATES

#: Anchors that are looked for in texts before words are split; with more, all texts are split.
MOST_ANCHORS = 200


def template_words(text: str) -> list[str]:
    """Normalised words of a template."""
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def bigrams(words: Sequence[str]) -> list[str]:
    """Distinct word bigrams in order."""
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def listed(templates: DataFrame) -> list[tuple[str, str]]:
    """The ``(name, text)`` rows of a table of templates, in the order of both."""
    rows = templates.select("name", "text").where("name is not null and text is not null")
    return [(r[0], r[1]) for r in rows.orderBy("name", "text").collect()]


def anchors(text: str, threshold: float) -> list[str]:
    """Words of a template of which every window that reaches the threshold holds one.

    Without any of them a window shares u bigrams at most, hence has a coefficient
    of ``2u / (u + n)`` at most. The longest words are taken until that is too little.
    """
    words = template_words(text)
    grams = bigrams(words)
    chosen: list[str] = []
    for word in sorted(set(words), key=lambda w: (-len(w), w)):
        left = [g for g in grams if not set(g.split()) & set(chosen)]
        if 2 * len(left) < threshold * (len(left) + len(grams)):
            break
        chosen.append(word)
    return chosen


def bounds(n: int, threshold: float) -> tuple[int, int]:
    """(least shared, most) bigrams of a window that reaches the threshold with a template of n."""
    return ceil(n * threshold / (2 - threshold) - 1e-9), int(n * (2 - threshold) / threshold + 1e-9)


def _word_pairs(low: Column) -> Column:
    """All word bigrams of a lower-cased text, in order and with repeats."""
    words = F.filter(F.split(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != F.lit(""))
    # Bound once by a one-element transform, so that the words are not split twice.
    pairs = F.transform(
        F.array(words),
        lambda w: F.zip_with(
            F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))),
            F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))),
            lambda a, b: F.concat(a, F.lit(" "), b),
        ),
    )
    return F.element_at(pairs, 1)


def quoted(text: str) -> str:
    """A string of the plan's SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal(items: list[str], kind: str) -> Column:
    """An array of constants, which the optimizer folds into one value (a JSON text would be parsed for every row)."""
    return F.expr(f"cast(array({', '.join(items)}) as {kind})")


def hash_table(spark, grams_of: list[tuple[str, list[str]]]) -> tuple[Column, int]:
    """Buckets of ``(g, ts)``, a bigram and the numbers of its templates, by ``xxhash64``; and how many buckets there are."""
    owners: dict[str, list[int]] = {}
    for k, (_, grams) in enumerate(grams_of):
        for g in grams:
            owners.setdefault(g, []).append(k)
    slots = 2 * len(owners) + 1
    buckets: list[list] = [[] for _ in range(slots)]
    if owners:
        rows = spark.createDataFrame([(g,) for g in owners], "g string")
        for g, slot in rows.select("g", F.pmod(F.xxhash64("g"), F.lit(slots))).collect():
            buckets[slot].append(f"named_struct('g', {quoted(g)}, 'ts', array({', '.join(map(str, owners[g]))}))")
    kind = "array<struct<g:string, ts:array<int>>>"
    return literal([f"array({', '.join(b)})" if b else f"cast(array() as {kind})" for b in buckets], f"array<{kind}>"), slots


def steps(pairs: str, marks: str) -> Column:
    """For every bigram of a text ``(at, back, on, ts)``: how far back and on the same one is (0: nowhere), and its templates."""
    ordered = F.array_sort(F.transform(pairs, lambda g, i: F.struct(g.alias("g"), (i + 1).alias("at"))))

    def linked(x: Column) -> Column:
        def far(one: Column, other: Column) -> Column:
            return F.when(one["g"] == other["g"], F.abs(one["at"] - other["at"])).otherwise(0)

        return F.transform(
            x,
            lambda one, k: F.struct(
                one["at"].alias("at"), far(one, F.get(x, k - 1)).alias("back"), far(one, F.get(x, k + 1)).alias("on")
            ),
        )

    placed = F.array_sort(F.element_at(F.transform(F.array(ordered), linked), 1))
    return F.zip_with(placed, marks, lambda s, m: F.struct(s["at"].alias("at"), s["back"].alias("back"), s["on"].alias("on"), m.alias("ts")))


def close(t: Column, i: Column, need: Column, whole: bool = False) -> Column:
    """Whether ``need`` of the template's bigrams from the i-th on (or from any on) lie within its longest window."""
    if whole:
        ahead = F.slice(t["own"], need, F.size(t["own"]))
        gaps = F.zip_with(F.slice(t["own"], 1, F.size(ahead)), ahead, lambda a, b: b - a < t["most"])
        return F.exists(gaps, lambda x: x)
    return F.coalesce(F.get(t["own"], i + need - 1) - F.get(t["own"], i) < t["most"], F.lit(False))


def best(t: Column, every: Column, threshold: float) -> Column:
    """A template's best window, from the running counts of each beginning that can still win."""

    def from_start(held: Column, a: Column, need: Column, near: Column) -> Column:
        """The better one of ``held`` and the windows that begin at a."""
        new = F.filter(F.slice(near, a, t["most"]), lambda x: (x["back"] == 0) | (x["at"] - x["back"] < a))
        shared = F.array_compact(
            F.transform(new, lambda x, k: F.when(x["own"], F.struct(x["at"].alias("at"), (k + 1).alias("distinct"))))
        )

        def top(hits: Column) -> Column:
            return F.array_min(
                F.transform(
                    hits,
                    lambda h, k: F.struct(
                        (-2.0 * (k + 1) / (h["distinct"] + t["n"])).alias("minus_dice"), (h["at"] - a).alias("longer"), a.alias("first")
                    ),
                )
            )

        enough = F.transform(F.array(shared), lambda hits: F.when(F.size(hits) >= need, F.least(held, top(hits))).otherwise(held))
        return F.element_at(enough, 1)

    def beginning(held: Column, i: Column, near: Column) -> Column:
        dice = F.greatest(-held["minus_dice"], F.lit(threshold))
        need = F.ceil(dice * t["n"] / (2 - dice) - 1e-9).cast("int")
        perfect = (held["minus_dice"] == -1.0) & (held["longer"] == t["n"] - 1)
        a = F.get(t["own"], i)
        # A window with one of the template's bigrams before it, which it doesn't hold, is better with that.
        before = F.coalesce(F.get(t["own"], i - 1) == a - 1, F.lit(False))
        on = F.get(near, a - 2)["on"]
        grows = before & ((on == 0) | (on > t["most"]))
        able = ~perfect & ~grows & close(t, i, need)
        found = F.transform(F.array(F.struct(a.alias("a"), need.alias("need"))), lambda x: from_start(held, x["a"], x["need"], near))
        return F.when(able, F.element_at(found, 1)).otherwise(held)

    nothing = F.struct(F.lit(1.0).alias("minus_dice"), F.lit(0).alias("longer"), F.lit(0).alias("first"))
    own = F.transform(
        every,
        lambda x: F.struct(
            x["at"].alias("at"), x["back"].alias("back"), x["on"].alias("on"),
            F.coalesce(F.array_contains(x["ts"], t["order"]), F.lit(False)).alias("own"),
        ),
    )
    window = F.transform(
        F.array(own),
        lambda near: F.aggregate(F.sequence(F.lit(0), F.size(t["own"]) - 1), nothing, lambda held, i: beginning(held, i, near)),
    )
    held = F.transform(
        window,
        lambda w: F.struct(
            w["minus_dice"].alias("minus_dice"), t["order"].alias("order"), w["longer"].alias("longer"), w["first"].alias("first"),
            (w["first"] + w["longer"]).alias("last"), t["name"].alias("name"),
        ),
    )
    return F.element_at(held, 1)


def scan_licenses(
    docs: DataFrame,
    threshold: float = 0.8,
    templates: Sequence[tuple[str, str]] | DataFrame = TEMPLATES,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``(key, n_matches, license, dice, word_no)`` for every row of docs.

    ``n_matches`` counts the templates whose best window counts; ``license``, ``dice``
    (six decimals) and ``word_no`` (its first word, from 1) are those of the best one.
    """
    if isinstance(templates, DataFrame):
        templates = listed(templates)
    grams_of = [(name, bigrams(template_words(t))) for name, t in templates]
    hints = sorted({a for _, t in templates for a in anchors(t, threshold)})
    known = literal(
        [
            f"named_struct('order', {k}, 'name', {quoted(name)}, 'n', {len(g)}, 'least', {least}, 'most', {most})"
            for k, (name, g) in enumerate(grams_of)
            if g
            for least, most in (bounds(len(g), threshold),)
        ],
        "array<struct<order:int, name:string, n:int, least:int, most:int>>",
    )
    table, slots = hash_table(docs.sparkSession, grams_of)
    low = F.lower(column(text))
    few = hints and len(hints) <= MOST_ANCHORS
    hinted = reduce(or_, (F.contains(low, F.lit(h)) for h in hints)) if few else F.lit(bool(hints))
    rows = docs.select(column(key).alias("key"), F.when(hinted, _word_pairs(low)).alias("pairs"))
    owners = lambda g: F.get(F.filter(F.get(table, F.pmod(F.xxhash64(g), F.lit(slots)).cast("int")), lambda x: x["g"] == g), F.lit(0))["ts"]
    rows = rows.select("key", "pairs", F.transform("pairs", owners).alias("marks"))
    hits = F.filter(F.transform("marks", lambda m, i: F.struct((i + 1).alias("at"), m.alias("ts"))), lambda h: h["ts"].isNotNull())
    rows = rows.select("key", "pairs", "marks", F.when(F.exists("marks", lambda m: m.isNotNull()), hits).alias("hits"))
    present = F.array_distinct(F.flatten(F.transform("hits", lambda h: h["ts"])))
    own = F.transform(
        F.filter(known, lambda t: F.array_contains(present, t["order"])),
        lambda t: F.struct(
            *(t[x].alias(x) for x in ("order", "name", "n", "least", "most")),
            F.transform(F.filter("hits", lambda h: F.array_contains(h["ts"], t["order"])), lambda h: h["at"]).alias("own"),
        ),
    )
    near = F.filter(own, lambda t: (F.size(t["own"]) >= t["least"]) & close(t, F.lit(0), t["least"], whole=True))
    rows = rows.select("key", "pairs", "marks", near.alias("near"))
    # Bound by a one-element transform, so that the steps aren't made anew for every window.
    tried = F.transform(F.array(steps("pairs", "marks")), lambda x: F.transform("near", lambda t: best(t, x, threshold)))
    found = F.filter(F.element_at(tried, 1), lambda m: m["minus_dice"] <= 1e-9 - threshold)
    rows = rows.select("key", F.when(F.size("near") > 0, found).alias("found"))
    counts = F.filter(
        "found",
        lambda m: ~F.exists("found", lambda o: (o < m) & (o["first"] <= m["last"]) & (m["first"] <= o["last"])),
    )
    rows = rows.select("key", counts.alias("counts"))
    top = F.array_min("counts")
    return rows.select(
        F.col("key").alias(key),
        F.greatest(F.coalesce(F.size("counts"), F.lit(0)), F.lit(0)).cast("long").alias("n_matches"),
        top["name"].alias("license"),
        F.round(-top["minus_dice"], 6).alias("dice"),
        top["first"].cast("long").alias("word_no"),
    )


def oracle(threshold: float = 0.8, templates: Sequence[tuple[str, str]] = TEMPLATES) -> str:
    """DuckDB SQL for scan_licenses over ``documents``, without anchors."""
    values = ", ".join(
        "({}, '{}', {!r}, {}, {})".format(k, name, grams, *bounds(len(grams), threshold))
        for k, (name, grams) in enumerate((n, bigrams(template_words(t))) for n, t in templates)
    )
    return f"""
WITH t(k, name, grams, least, most) AS (VALUES {values}),
word AS (
  SELECT doc_id,
         list_filter(string_split(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '') AS w
  FROM documents
), pair AS (
  SELECT doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM word WHERE len(w) > 1
), wanted AS (SELECT k, unnest(grams) AS gram FROM t),
hit AS (
  SELECT doc_id, k, p.i, row_number() OVER (PARTITION BY doc_id, k ORDER BY p.i) AS r
  FROM (SELECT doc_id, unnest(g) AS gram, generate_subscripts(g, 1) AS i FROM pair) p JOIN wanted USING (gram)
), near AS (
  SELECT a.doc_id, a.k, a.i AS first, b.i AS last
  FROM hit a JOIN t USING (k) JOIN hit b
    ON b.doc_id = a.doc_id AND b.k = a.k AND b.r >= a.r + t.least - 1 AND b.i - a.i < t.most
), score AS (
  SELECT doc_id, k, name, first, last,
         2.0::DOUBLE * len(list_intersect(g[first:last], grams)) / (len(list_distinct(g[first:last])) + len(grams)) AS dice
  FROM near JOIN pair USING (doc_id) JOIN t USING (k)
), best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY dice DESC, last - first, first) AS r FROM score
), found AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, k) AS place
  FROM best WHERE r = 1 AND dice >= {threshold} - 1e-9
), counted AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS d, count(*) OVER (PARTITION BY doc_id) AS n
  FROM found m WHERE NOT EXISTS (
    SELECT 1 FROM found o
    WHERE o.doc_id = m.doc_id AND o.place < m.place AND o.first <= m.last AND m.first <= o.last)
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_matches, name AS license, round(dice, 6) AS dice, first::BIGINT AS word_no
FROM documents LEFT JOIN (SELECT * FROM counted WHERE d = 1) USING (doc_id)
"""
