"""Mixing sources to target weights by a low-discrepancy schedule.

Only DataFrame operations. Sizes are words. Every source has a target number of
words. The mix consists of slots of ``block`` words each; slot i takes the point
``frac(i * golden ratio)``, which falls into one source's share of the unit
interval, so that every stretch of the schedule holds the sources in proportion.
The slots of one source are ranked, and slot r takes block r of that source's
documents in shuffled order, block r being words ``r * block`` up to
``(r + 1) * block`` of that order repeated. A source gets its target, rounded to
whole words, at every size of input: its last block is a partial one, slots that
the schedule gives it beyond that stay empty, and where the schedule gives too
few (a target below one slot may get none) slots are added at the end. All other
blocks hold equally many words, and a source is repeated evenly, ``repeats``
times at most.

Offsets in the shuffled order and ranks in the schedule are running sums in three
levels (within buckets of the order, over the buckets of a stretch, over the
stretches), so that no task holds a whole source or all of its buckets.

Edge cases: a null or empty text has size 0 and nothing is taken of it; a null
source is a source of its own, the last in order; rows that repeat an id are
separate rows (their order among equal rows doesn't matter, for they are alike);
with no words at all every target is 0; an empty table gives an empty table;
other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, free_names, materialise, word_count

GOLDEN = (math.sqrt(5) - 1) / 2
#: Words in a block at most, and slots at least (where there are as many words).
BLOCK_WORDS, LEAST_SLOTS = 4096, 16_384
#: Documents in a bucket of a source's order and slots in a stretch of the schedule, about.
BUCKET_ROWS, STRETCH_SLOTS = 512, 8192
#: Cells of the unit interval by which points find their source.
GRID = 1024
#: Buckets of a source whose sums are added up in one task.
STRETCH_BUCKETS = 4096


def sums_before(rows: DataFrame, group: str, order: str, value: str, stretch: int | None = None) -> DataFrame:
    """``(group, order, start)``: the sum of ``value`` over a group's rows of lower ``order`` (whole numbers, one row each).

    Sums go over stretches of the order first and within each stretch after that.
    """
    wide = F.floor(F.col(order) / (stretch or STRETCH_BUCKETS))
    rows = rows.withColumn("stretch", wide)
    before = lambda *keys: (
        Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    )
    total = rows.groupBy(group, "stretch").agg(F.sum(value).alias("sum"))
    total = total.select(group, "stretch", F.coalesce(F.sum("sum").over(before(group, "stretch")), F.lit(0)).alias("far"))
    near = F.coalesce(F.sum(value).over(before(group, "stretch", order)), F.lit(0))
    return (
        rows.withColumn("near", near)
        .join(total, [group, "stretch"])
        .select(group, order, (F.col("near") + F.col("far")).alias("start"))
    )


def source_targets(sized: DataFrame, weights: Sequence[int] = (1, 2, 3), repeats: int = 3) -> DataFrame:
    """``(source, src, source_size, target)`` for ``(source, size)`` rows.

    Sources in code-point order (null last) weigh ``weights`` in turn and share
    all words; a target stops at ``repeats`` times its source's size and what is
    over is shared again by weight. Filling in the order of limit per weight
    gives that fixed point in one pass.
    """
    own = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    own = own.withColumn("src", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.element_at(cycle, (F.col("src") % len(weights) + 1).cast("int"))
    )
    full = own.withColumn("most", F.col("source_size") * float(repeats))
    order = Window.orderBy(F.col("most") / F.col("weight"), "src")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (
        F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    ) / F.sum("weight").over(onward)
    levelled = full.withColumn("level", level)
    # The level rises past every source that is full and falls from the first that isn't.
    levelled = levelled.withColumn("final", F.max("level").over(everything))
    target = F.least(F.col("most"), F.col("final") * F.col("weight"))
    return levelled.select("source", "src", "source_size", target.alias("target"))


def schedule(targets: DataFrame, slots: int) -> DataFrame:
    """``(slot, src, rank)``: the source of every slot and the slot's rank within that source."""
    spark = targets.sparkSession
    order = Window.orderBy("src")
    total = F.sum("target").over(Window.partitionBy())
    shares = targets.where("target > 0").withColumn("hi", F.sum("target").over(order) / total)
    shares = shares.select(
        "src",
        F.lag("hi", 1, 0.0).over(order).alias("lo"),
        F.when(F.lead("src").over(order).isNull(), F.lit(2.0)).otherwise(F.col("hi")).alias("hi"),
    )
    cells = shares.withColumn(
        "cell",
        F.explode(
            F.sequence(
                F.floor(F.col("lo") * GRID).cast("int"),
                F.least(F.floor(F.col("hi") * GRID), F.lit(GRID - 1)).cast("int"),
            )
        ),
    )
    turn = (F.col("id") + 1) * F.lit(GOLDEN)
    points = spark.range(slots).select(F.col("id").alias("slot"), (turn - F.floor(turn)).alias("x"))
    points = points.withColumn("cell", F.floor(F.col("x") * GRID).cast("int"))
    placed = (
        points.join(cells, "cell")
        .where("x >= lo and x < hi")
        .select("slot", "src", F.floor(F.col("slot") / STRETCH_SLOTS).alias("stretch"))
    )
    counts = placed.groupBy("src", "stretch").agg(F.count("*").alias("n"))
    starts = sums_before(counts.withColumnRenamed("stretch", "at"), "src", "at", "n").withColumnRenamed("at", "stretch")
    within = F.row_number().over(Window.partitionBy("src", "stretch").orderBy("slot")) - 1
    return (
        placed.withColumn("at", within)
        .join(starts, ["src", "stretch"])
        .select("slot", "src", (F.col("start") + F.col("at")).alias("rank"))
    )


def filled_up(slots: DataFrame, targets: DataFrame, block: int) -> DataFrame:
    """``(src, rank)``: the scheduled slots, and those that a target takes beyond them.

    Shares of the schedule are within a few slots of the targets, so few are added.
    """
    given = slots.groupBy("src").agg(F.count("*").alias("given"))
    wanted = targets.select("src", F.expr(f"(used + {block - 1}) div {block}").alias("blocks"))
    short = wanted.join(given, "src", "left").withColumn("given", F.coalesce("given", F.lit(0).cast("long")))
    added = short.where("given < blocks").select("src", F.explode(F.expr("sequence(given, blocks - 1)")).alias("rank"))
    return slots.select("src", "rank").unionByName(added)


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (1, 2, 3),
    repeats: int = 3,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    block_words: int = BLOCK_WORDS,
    seed: int = 1,
) -> DataFrame:
    """``(key, size, source_size, target, taken)`` for every row of docs."""
    sized = materialise(
        docs.select(
            column(key).alias("id"), column(source).alias("source"), word_count(column(text)).alias("size")
        )
    )
    targets = source_targets(sized, weights, repeats)
    targets = materialise(targets.withColumn("used", F.floor(F.col("target") + 0.5)))
    rows, words = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    block = max(1, min(block_words, words // LEAST_SLOTS))
    slots = filled_up(materialise(schedule(targets, -(-words // block))), targets, block)
    bits = max(1, math.ceil(math.log2(max(2, rows / BUCKET_ROWS))))

    named = sized.join(
        targets.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))
    ).drop("name", "source")
    hashed = F.xxhash64(F.lit(seed), "id", "size")
    ordered = named.withColumn("h", hashed).withColumn("bucket", F.shiftrightunsigned("h", 64 - bits))
    sums = ordered.groupBy("src", "bucket").agg(F.sum("size").alias("n"))
    starts = sums_before(sums, "src", "bucket", "n")
    within = (
        Window.partitionBy("src", "bucket")
        .orderBy("h", "id", "size")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    located = materialise(
        ordered.withColumn("upto", F.sum("size").over(within))
        .join(starts, ["src", "bucket"])
        .select(
            "id", "size", "src", "source_size", "target", "used",
            (F.col("start") + F.col("upto") - F.col("size")).alias("off"),
        )
    )

    # A document lies at off, off + source_size, ... of its source's repeated order.
    turns = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda e: F.col("off") + e * F.col("source_size")),
        lambda at: at < F.col("used"),
    )
    pieces = (
        located.where("size > 0")
        .withColumn("at", F.explode(turns))
        .withColumn(
            "rank",
            F.explode(F.expr(f"sequence(at div {block}, (least(at + size, used) - 1) div {block})")),
        )
    )
    overlap = F.least(F.col("at") + F.col("size"), (F.col("rank") + 1) * block, "used") - F.greatest(
        F.col("at"), F.col("rank") * block
    )
    columns = ["id", "size", "src", "source_size", "target", "off"]
    taken = pieces.join(slots, ["src", "rank"]).select(
        *columns, overlap.alias("taken")
    )
    nothing = located.select(*columns, F.lit(0).cast("long").alias("taken"))
    # Source and offset tell apart all rows but those without words, which stand for themselves.
    some = taken.union(nothing.where("size > 0")).groupBy(*columns).agg(F.sum("taken").alias("taken"))
    return some.union(nothing.where("size = 0")).select(
        F.col("id").alias(key), "size", "source_size", "target", "taken"
    )


def mixed_documents(
    docs: DataFrame,
    weights: Sequence[int] = (1, 2, 3),
    repeats: int = 3,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """docs with every row as often as the mix takes it, to the nearest whole number.

    The columns are those of docs. A row's copies are ``taken / size`` rounded,
    halves up. Ids are expected to be unique; where one repeats, each of its rows
    comes as often as the row of that id and size of which most is taken. A row
    without words or with a null id comes once.
    """
    words, times = free_names(docs.columns, "mix_words", "mix_times")
    plan = mix(docs, weights, repeats, key, source, text).where("size > 0")
    copies = F.max(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int")
    plan = plan.groupBy(F.col(key).alias("id"), F.col("size").alias("words")).agg(copies.alias("copies"))
    left = docs.select(*(column(c) for c in docs.columns), word_count(column(text)).alias(words)).alias("left")
    on = (F.col(f"left.`{key}`") == F.col("plan.id")) & (F.col(f"left.`{words}`") == F.col("plan.words"))
    joined = left.join(plan.alias("plan"), on, "left")
    every = [F.col(f"left.`{c}`") for c in docs.columns]
    repeated = joined.select(*every, F.coalesce("plan.copies", F.lit(1)).alias(times)).where(F.col(times) > 0)
    again = F.explode(F.array_repeat(F.lit(1), F.col(times)))
    return repeated.withColumn(times, again).drop(times)
