"""Sessions: threads by gap and similarity, as-of context, buckets, rollups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import ordered, policy
from tidemark.operators.folds import fold_in_order
from tidemark.operators.memory import rate_limited
from tidemark.operators.search import jaccard


def split_on(rows: DataFrame, by: str, starts: Column, *order: str, name: str = "segment") -> DataFrame:
    """rows with a number from 0 that grows where ``starts`` holds; the first row of a key starts nothing new."""
    w = Window.partitionBy(by).orderBy(*order)
    begins = F.when(F.row_number().over(w) == 1, 0).otherwise(F.when(starts, 1).otherwise(0))
    marked = rows.withColumn("_begins", begins)
    return marked.withColumn(name, F.sum("_begins").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_begins")


def gap_sessions(
    rows: DataFrame, by: str, ts: str, key: str, seconds: float, at_gap: bool = True, span_seconds: float | None = None
) -> DataFrame:
    """Sessions of a key: a new one begins when ``seconds`` have passed (``at_gap``: or exactly that).

    With ``span_seconds`` keys are cut into spans of that time, so that a very common key
    isn't one task's work.
    """
    if span_seconds is not None:
        held = ordered.previous(rows, [by], ts, key, span_seconds, _before=ts)
        gap = (F.unix_micros(ts) - F.unix_micros("_before")) / 1e6
        begins = F.when(gap >= seconds if at_gap else gap > seconds, 1).otherwise(0)
        marked = held.select(*rows.columns, begins.alias("_begins"))
        return ordered.running(marked, [by], ts, key, span_seconds, "_begins", "session").drop("_begins")
    w = Window.partitionBy(by).orderBy(ts, key)
    gap = (F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(w))) / 1e6
    return split_on(rows, by, gap >= seconds if at_gap else gap > seconds, ts, key, name="session")


def threads(
    rows: DataFrame, by: str, ts: str, key: str, app: str, title: str | None = None, minutes: float = 15,
    app_similarity: float = 0.5, title_similarity: float = 0.3, span_seconds: float | None = None,
) -> DataFrame:
    """Threads: a new one begins after a longer gap, or where neither application nor title is similar.

    Only the row before matters. With ``span_seconds`` keys are cut into spans of that time,
    so that a very common key isn't one task's work.
    """

    def words(column: Column) -> Column:
        return F.filter(F.split(F.lower(F.coalesce(column, F.lit(""))), r"\W+"), lambda x: x != "")

    def starts(before) -> Column:
        gap = (F.unix_micros(ts) - F.unix_micros(before(ts))) / 1e6 / 60
        apart = jaccard(words(F.col(app)), words(before(app))) < app_similarity
        if title is not None:
            apart = apart & (jaccard(words(F.col(title)), words(before(title))) < title_similarity)
        return (gap > minutes) | apart

    if span_seconds is not None:
        names = {c: f"_before_{c}" for c in (ts, app, *([title] if title is not None else []))}
        held = ordered.previous(rows, [by], ts, key, span_seconds, **{n: c for c, n in names.items()})
        # The first row of a key has none before it and begins nothing.
        begins = F.when(F.col(names[ts]).isNotNull() & starts(lambda c: F.col(names[c])), 1).otherwise(0)
        marked = held.select(*rows.columns, begins.alias("_begins"))
        return ordered.running(marked, [by], ts, key, span_seconds, "_begins", "thread").drop("_begins")
    w = Window.partitionBy(by).orderBy(ts, key)
    return split_on(rows, by, starts(lambda c: F.lag(c).over(w)), ts, key, name="thread")


def rollup(rows: DataFrame, by: str, segment: str, ts: str, key: str, app: str) -> DataFrame:
    """One row per segment: its ends, first and last application and size. Its members are rows of ``positions``."""
    place = F.struct(ts, key)
    return rows.groupBy(by, segment).agg(
        F.min(ts).alias("ts_start"), F.max(ts).alias("ts_end"), F.min_by(app, place).alias("first_app"),
        F.max_by(app, place).alias("last_app"), F.count("*").alias("n_events"),
    )


def positions(rows: DataFrame, by: str, *order: str) -> DataFrame:
    """rows with ``position`` from 0 within a key."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)


def as_of_context(
    rows: DataFrame, by: str, ts: str, key: str, context: Column, name: str = "context", span_seconds: float | None = None
) -> DataFrame:
    """rows with the latest non-null context at or before them: an as-of join of a table with itself.

    Rows at one time see each other's context. With ``span_seconds`` keys are cut into spans
    of that time, so that a very common key isn't one task's work.
    """
    if span_seconds is not None:
        # The context of each time that sets one, which its rows and the later ones see.
        set_at = rows.where(context.isNotNull()).groupBy(by, F.col(ts).alias("_at"))
        set_at = set_at.agg(F.max_by(F.struct(context.alias("c")), key).alias("_set"))
        return as_of_join(rows, set_at, by, ts, "_at", ["_set"], span_seconds).withColumn(name, F.col("_set.c")).drop("_set")
    w = Window.partitionBy(by).orderBy(ts).rangeBetween(Window.unboundedPreceding, 0)
    latest = F.max(F.when(context.isNotNull(), F.struct(F.col(ts), F.col(key), context.alias("c")))).over(w)
    return rows.withColumn(name, latest["c"])


def as_of_join(
    left: DataFrame, right: DataFrame, by: str, ts: str, right_ts: str, payload: list[str], span_seconds: float | None = None
) -> DataFrame:
    """left with the payload of the latest right row of the same key at or before it.

    Both sides go through one shuffle as a union; there is no join product. With
    ``span_seconds`` keys are cut into spans of that time and the latest row of each is
    carried on, so that a very common key isn't one task's work.
    """
    packed = F.struct(*(F.col(c) for c in payload))
    kind = right.select(packed).schema[0].dataType
    a = left.select(
        F.col(by).alias("_by"), F.col(ts).alias("_ts"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"),
        F.lit(None).cast(kind).alias("_r"),
    )
    b = right.select(
        F.col(by).alias("_by"), F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"),
        F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), packed.alias("_r"),
    )
    both = a.unionByName(b)
    if span_seconds is not None:
        seen = ordered.latest(both, ["_by"], "_ts", "_side", span_seconds, "_r", "_last").where("_side = 1")
    else:
        w = Window.partitionBy("_by").orderBy("_ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
        seen = both.withColumn("_last", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    return seen.select("_l.*", *(F.col(f"_last.{c}").alias(c) for c in payload))


def tumbling(rows: DataFrame, by: list[str], ts: str, seconds: int) -> DataFrame:
    """``(by, bucket, n)``: counts in aligned buckets of time."""
    start = F.window(ts, f"{seconds} seconds")["start"]
    return rows.groupBy(*by, start.alias("bucket")).agg(F.count("*").alias("n"))


def changes(rows: DataFrame, by: str, ts: str, key: str, value: str, span_seconds: float | None = None) -> DataFrame:
    """``(by, key, ts, old, new)`` where a value differs from the one before; keys may be cut into spans of time."""
    if span_seconds is not None:
        seen = ordered.previous(rows.select(by, key, ts, F.col(value).alias("new")), [by], ts, key, span_seconds, old="new")
    else:
        w = Window.partitionBy(by).orderBy(ts, key)
        seen = rows.select(by, key, ts, F.lag(value).over(w).alias("old"), F.col(value).alias("new"))
    seen = seen.select(by, key, ts, "old", "new")
    return seen.where(F.col("old").isNotNull() & (F.col("old") != F.col("new")))


#: Counters of an input bucket (fixed names).
COUNTERS = (
    "keyboard_events", "mouse_left_clicks", "mouse_right_clicks", "mouse_middle_clicks", "mouse_wheel_events",
    "mouse_wheel_delta", "mouse_move_dx", "mouse_move_dy",
)


def input_buckets(
    rows: DataFrame, by: str, ts: str, key: str, device: str, flush_seconds: float, idle_seconds: float, movement: bool = True
) -> DataFrame:
    """``(by, session, bucket, ts_start, ts_end, n, COUNTERS)`` of input events and changes of the foreground.

    ``device`` is keyboard, mouse or foreground; rows have the COUNTERS (null: 0; a keyboard
    row counts once at least). A bucket is flushed once ``flush_seconds`` have passed
    since it began, by any mouse row once it holds something, and by a foreground row; a
    session ends when nothing came for ``idle_seconds``. Foreground rows are in no bucket.
    """
    shown = [c for c in COUNTERS if movement or not c.startswith("mouse_move")]
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") if c in rows.columns else F.lit(0).cast("long") for c in COUNTERS})
    typed = F.when(F.col(device) == "keyboard", F.greatest("keyboard_events", F.lit(1))).otherwise(F.lit(0))
    rows = rows.withColumn("keyboard_events", typed.cast("long"))
    millis = lambda t: int(t.timestamp() * 1000 + 0.5)

    def step(held: tuple, group: tuple, row: dict) -> tuple:
        session, bucket, last, start, content = held
        now = millis(row[ts])
        if last is not None and now - last >= idle_seconds * 1000:
            session, bucket, last, start, content = session + 1, bucket + (start is not None), None, None, False
        if row[device] == "foreground":
            return (session, bucket + (start is not None), last, None, False), None
        if start is None:
            start, content = now, False
        own = f"{session}:{bucket}"
        content = content or any(row[c] for c in shown)
        done = now - start >= flush_seconds * 1000 or (row[device] == "mouse" and content)
        if done:
            return (session, bucket + 1, now, None, False), own
        return (session, bucket, now, start, content), own

    placed = fold_in_order(rows.select(by, ts, key, device, *COUNTERS), [by], [ts, key], step, "_at", "string", (0, 0, None, None, False))
    inside = placed.where("_at is not null")
    at = F.split("_at", ":")
    return inside.groupBy(by, at[0].cast("long").alias("session"), at[1].cast("long").alias("bucket")).agg(
        F.min(ts).alias("ts_start"), F.max(ts).alias("ts_end"), F.count("*").alias("n"), *(F.sum(c).alias(c) for c in shown)
    )


def input_activity(rows: DataFrame, by: str, ts: str, key: str, kind: str, context: str, denied: Sequence[str], seconds: float) -> DataFrame:
    """``(by, ts, key, kind, context)`` of foreground changes and of input under the context that they set.

    A foreground row of a denied process sets no context and isn't kept; input without
    a context isn't kept; of one context input within ``seconds`` of the last kept one isn't.
    """
    set_by = F.when(F.col(kind) == "foreground", F.when(policy.denied_process(F.col(context), denied), "").otherwise(F.col(context)))
    seen = as_of_context(rows, by, ts, key, set_by, "_now").where("_now is not null and _now <> ''")
    changes_ = seen.where((F.col(kind) == "foreground") & (F.col(context) == F.col("_now")))
    typed = seen.where(F.col(kind) != "foreground").withColumn(context, F.col("_now"))
    kept = rate_limited(typed.select(by, ts, key, kind, context), [by, context], ts, seconds, key).where("accepted").drop("accepted")
    return changes_.select(by, ts, key, kind, context).unionByName(kept)
