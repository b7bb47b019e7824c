"""Policies: proposals, artifacts, captures, namespaces, staleness; scout ranking and frame duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scoring, text
from tidemark.operators import ordered
from tidemark.operators.folds import fold_in_order

# Words that mark preferences, and patterns of statements about persons.
PREFERENCE_WORDS = (
    "preference", "preferences", "likes", "dislikes", "favorite", "favourite", "user_profile", "user_preferences",
)
PERSON_PATTERNS = (
    r"\b(?:employee|person|user|owner|manager|lead|contact)\s*:\s*[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}\b",
    r"\b(?:mr|ms|mrs|dr)\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}\b",
)
PERSON_KINDS = ("person", "user", "individual", "employee")
SENSITIVITY = ("low", "medium", "high")


def _caseless(patterns: Sequence[str]) -> list[str]:
    return ["(?i)" + p.removeprefix("(?i)") for p in patterns]


def _allowed(audiences: Column, allowed: Sequence[str]) -> Column:
    """Whether any audience is allowed, without regard to case; none is allowed where there are none."""
    low = F.transform(F.coalesce(audiences, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    return F.arrays_overlap(low, F.array(*(F.lit(a.strip().lower()) for a in allowed)))


def query_policy_reasons(sensitivity: Column, audiences: Column, allowed: Sequence[str]) -> Column:
    """Why a reader's policy is refused, in order: no audience, unknown sensitivity, audience not allowed."""
    return F.array_compact(F.array(*_policy_checks(sensitivity, audiences, allowed)))


def _policy_checks(sensitivity: Column, audiences: Column, allowed: Sequence[str]) -> list[Column]:
    checks = {
        "policy_audience_missing": F.coalesce(F.size(audiences) <= 0, F.lit(True)),
        "policy_sensitivity_invalid": ~F.coalesce(sensitivity.isin(*SENSITIVITY), F.lit(False)),
        "policy_audience_blocked": ~F.coalesce(_allowed(audiences, allowed), F.lit(False)),
    }
    return [F.when(failed, F.lit(name)) for name, failed in checks.items()]


def proposal_reasons(
    body: Column, keys: Column, kinds: Column, sensitivity: Column, audiences: Column, allowed: Sequence[str],
    has_policy: Column | None = None,
) -> Column:
    """Why a proposed memory is refused, in order; empty when it isn't.

    ``keys`` are the keys of its JSON content at any depth, ``kinds`` those of its
    entities. Without content, or without a policy, that is the only reason.
    """
    checks = _policy_checks(sensitivity, audiences, allowed)
    plain = text.normalise_text(F.coalesce(body, F.lit("")))
    lower = F.lower(plain)
    wordy = F.lit(False)
    for word in PREFERENCE_WORDS:
        wordy = wordy | F.contains(lower, F.lit(word))
    listed = lambda x, known: F.coalesce(F.exists(x, lambda v: F.lower(F.trim(v)).isin(*known)), F.lit(False))
    found = {
        "policy_pii_detected": text.has_any(body, _caseless(text.PII_PATTERNS)),
        "policy_secret_detected": text.has_any(body, _caseless([p for p, _ in text.SECRET_PATTERNS])),
        "policy_person_entity_detected": listed(kinds, PERSON_KINDS),
        "policy_person_text_detected": text.has_any(plain, _caseless(PERSON_PATTERNS)),
        "policy_preference_detected": wordy | listed(keys, PREFERENCE_WORDS),
    }
    every = F.array_compact(F.array(*checks, *(F.when(hit, F.lit(name)) for name, hit in found.items())))
    out = F.when(F.trim(F.coalesce(body, F.lit(""))) == "", F.array(F.lit("content_empty")))
    if has_policy is not None:
        out = out.when(~has_policy, F.array(F.lit("policy_missing")))
    return out.otherwise(every)


def artifact_decision(
    body: Column, exclude: Sequence[str], redact: Sequence[str], labels: Column | None = None, blocked: Sequence[str] = ()
) -> Column:
    """``struct(action, reason)``: blocked labels, then excluding, then redacting patterns; case doesn't count.

    Without labels it is the decision on a span.
    """
    out = F.when(text.has_any(body, _caseless(exclude)), _decision("exclude", "exclude_pattern"))
    if labels is not None and blocked:
        low = F.transform(labels, lambda x: F.lower(F.trim(x)))
        hit = F.arrays_overlap(low, F.array(*(F.lit(b.strip().lower()) for b in blocked)))
        out = F.when(F.coalesce(hit, F.lit(False)), _decision("exclude", "blocked_labels")).when(
            text.has_any(body, _caseless(exclude)), _decision("exclude", "exclude_pattern")
        )
    return out.when(text.has_any(body, _caseless(redact)), _decision("redact", "redact_pattern")).otherwise(
        _decision("allow", None)
    )


def _decision(action: str, reason: str | None) -> Column:
    return F.struct(F.lit(action).alias("action"), F.lit(reason).cast("string").alias("reason"))


def denied_process(process: Column, processes: Sequence[str]) -> Column:
    """Whether a process is on a list, without regard to case and blanks around it; a blank name isn't."""
    known = [p.strip().lower() for p in processes if p and p.strip()]
    return F.coalesce(F.lower(F.trim(process)).isin(*known), F.lit(False)) if known else F.lit(False)


def capture_skipped(
    paused: Column, monitor: Column, process: Column, title: Column, monitors: Sequence[str], processes: Sequence[str],
    titles: Sequence[str],
) -> Column:
    """Why a capture is skipped, null when it isn't: paused, its monitor, its process, its title (by pattern)."""
    return (
        F.when(paused, "paused")
        .when(F.coalesce(monitor.isin(*monitors), F.lit(False)), "monitor")
        .when(denied_process(process, processes), "process")
        .when(text.has_any(title, titles), "title")
    )


def namespace_view(rows: DataFrame, namespace: str, column: str = "namespace") -> DataFrame:
    """Rows of one namespace only: what a reader bound to it may scan. Pushed down, it prunes partitions."""
    return rows.where(F.col(column) == namespace)


def stale_split(items: DataFrame, as_of: Column, hours: float, seen: str, snoozed: str | None = None) -> DataFrame:
    """items that aren't snoozed, with ``stale``: last seen more than ``hours`` ago (not exactly that)."""
    rows = items if snoozed is None else items.where(F.col(snoozed).isNull() | (F.col(snoozed) <= as_of))
    age = F.unix_micros(as_of) - F.unix_micros(seen)
    return rows.withColumn("stale", age > int(hours * 3.6e9))


def backlog(rows: DataFrame, as_of: Column, ts: str, done: Column, risk_hours: float) -> DataFrame:
    """One row: how many rows aren't done, how many of those are at risk, and the oldest one's age in hours."""
    age = (F.unix_micros(as_of) - F.unix_micros(ts)) / 3.6e9
    return rows.agg(
        F.count_if(~done).alias("missing"),
        F.count_if(~done & (age > risk_hours)).alias("at_risk"),
        F.round(F.coalesce(F.max(F.when(~done, age)), F.lit(0.0)), 6).alias("oldest_hours"),
    )


def compare_strategies(results: DataFrame, strategy: str, answer: str, expected: str, ms: str) -> DataFrame:
    """``(strategy, pass_rate, mean_tokens, mean_ms)``: answers pass if they are equal without regard to case."""
    passed = (F.lower(F.trim(answer)) == F.lower(F.trim(expected))).cast("double")
    return results.groupBy(strategy).agg(
        F.round(F.avg(passed), 6).alias("pass_rate"),
        F.round(F.avg(text.token_estimate(F.col(answer))), 6).alias("mean_tokens"),
        F.round(F.avg(ms), 6).alias("mean_ms"),
    )


def scout(items: DataFrame, value: str, title: str, keywords: Sequence[str], *ties: str) -> DataFrame:
    """Items whose title holds a keyword, by normalised value, with ``rank``.

    A keyword of several words must occur as a phrase, or each of its words as the
    beginning of a word of the title.
    """
    low = F.lower(F.col(title))
    words = F.split(low, r"\W+")
    hit = F.lit(False)
    for keyword in keywords:
        parts = keyword.lower().split()
        each = F.lit(True)
        for part in parts:
            each = each & F.exists(words, _starts(part))
        hit = hit | F.contains(low, F.lit(keyword.lower())) | each
    bounded = scoring.with_bounds(items.where(hit), _value=value)
    score = F.round(scoring.between(F.col(value), F.col("_value_low"), F.col("_value_high")), 6)
    scored = bounded.select(*items.columns, score.alias("score"))
    return ordered.rank_over_all(scored, "score", ties=ties)


def _starts(part: str):
    return lambda w: w.startswith(part)


def frame_duplicates(
    frames: DataFrame, by: str, ts: str, bits: str, pixels: str | None = None, window_seconds: float = 10,
    fraction: float = 0.02, error: float = 2.5, most: int = 16, key: str | None = None,
) -> DataFrame:
    """frames with ``duplicate``: like one of the last ``most`` distinct frames within a time.

    ``bits`` is a 64-bit hash; frames are alike if at most ``fraction`` of the bits
    differ and, where ``pixels`` names a small grey image (an array of numbers), its mean
    absolute error is at most ``error``. Duplicates aren't remembered, so decisions hang
    on earlier ones; a key goes through in order with ``most`` frames carried on.
    """

    def alike(row: dict, other: tuple) -> bool:
        differ = ((int(row[bits]) ^ int(other[1])) & (1 << 64) - 1).bit_count()
        if differ > 64 * fraction:
            return False
        if pixels is None:
            return True
        a, b = row[pixels], other[2]
        return len(a) == len(b) and sum(abs(x - y) for x, y in zip(a, b)) <= error * max(1, len(a))

    def step(held: tuple, group: tuple, row: dict) -> tuple:
        near = tuple(h for h in held if (row[ts] - h[0]).total_seconds() <= window_seconds)[-most:]
        same = any(alike(row, h) for h in near)
        if not same:
            near = (*near, (row[ts], row[bits], None if pixels is None else row[pixels]))
        return near, same

    return fold_in_order(frames, [by], [ts, key or bits], step, "duplicate", "boolean", start=(), uses=[ts, bits, *([pixels] if pixels else [])])
