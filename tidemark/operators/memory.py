"""Memory: hotness and its selection, candidate ranking, packing, graph expansion, policy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scoring
from tidemark.operators.folds import fold_in_order, spaced

# Half-lives in seconds, weights, quotas and bins of hotness.
HALF_LIVES = {"fast": 3600.0, "mid": 21600.0, "warm": 86400.0, "cool": 604800.0}
WEIGHTS = {"fast": 0.4, "mid": 0.3, "warm": 0.2, "cool": 0.1}
QUOTAS = {"hot": 0.4, "recent": 0.3, "warm": 0.2, "cool": 0.1}
BINS = {"hot": 0.75, "recent": 0.5, "warm": 0.25, "cool": 0.1}


def hotness(touches: DataFrame, item: str, ts: str, weight: Column, as_of: Column) -> DataFrame:
    """``(item, score, last_ts)``: four decaying sums of touches, mixed.

    Decay is exponential, so folding touches in time order equals one aggregate
    of decayed weights, which is summed within tasks before the shuffle.
    """
    age = scoring.age_seconds(F.col(ts), as_of)
    shares = [
        F.sum(scoring.half_life(weight, age, half)) * WEIGHTS[name] for name, half in HALF_LIVES.items()
    ]
    return touches.groupBy(item).agg(
        F.round(sum(shares[1:], shares[0]), 6).alias("score"), F.max(ts).alias("last_ts")
    )


def bin_of(score: Column) -> Column:
    out = None
    for name, least in BINS.items():
        out = F.when(score >= least, name) if out is None else out.when(score >= least, name)
    return out.otherwise("cold")


def quota_targets(limit: int) -> dict[str, int]:
    """Places of each bin: its share rounded down, then one more each, hottest first."""
    out = {name: int(limit * share) for name, share in QUOTAS.items()}
    for name in list(out)[: max(0, limit - sum(out.values()))]:
        out[name] += 1
    return out


def select_hot(rows: DataFrame, limit: int, item: str) -> DataFrame:
    """``(item, score, bin, position)``: each bin's best up to its quota, then the best of the rest.

    Cold items are never chosen. Bins are cut to ``limit`` rows within every task
    first, so what is ordered as a whole has ``4 * limit`` rows at most.
    """
    targets = quota_targets(limit)
    binned = rows.withColumn("bin", bin_of(F.col("score"))).where(F.col("bin") != "cold")
    w = Window.partitionBy("bin").orderBy(F.desc("score"), item)
    head = binned.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)
    quota = F.element_at(F.create_map(*(F.lit(x) for p in targets.items() for x in p)), F.col("bin"))
    place = F.element_at(F.create_map(*(F.lit(x) for p in zip(BINS, range(4)) for x in p)), F.col("bin"))
    spilled = head.withColumn("late", (F.col("n") > quota).cast("int")).withColumn("place", place)
    order = Window.orderBy("late", F.when(F.col("late") == 0, F.col("place")), F.desc("score"), item)
    return (
        spilled.withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= limit)
        .select(item, "score", "bin", "position")
    )


def select_pins(pins: DataFrame, limits: Mapping[str, int], item: str) -> DataFrame:
    """pins with ``kept``: the first of each level by rank, up to the level's limit."""
    w = Window.partitionBy("pin_level").orderBy("pin_rank", item)
    limit = F.element_at(F.create_map(*(F.lit(x) for p in limits.items() for x in p)), F.col("pin_level"))
    return pins.withColumn("kept", F.row_number().over(w) <= F.coalesce(limit, F.lit(0)))


def rate_limited(
    touches: DataFrame, by: list[str], ts: str, seconds: float, key: str, span_seconds: float | None = None
) -> DataFrame:
    """touches with ``accepted``: at least ``seconds`` after the last accepted one of its key.

    Each decision hangs on the one before. With ``span_seconds`` keys are cut into such spans, so that a
    key with most of the rows is work for all tasks (rows without a time are left out). Without it a
    key's rows go through one task in order, batch by batch, with the last accepted time carried on.
    """
    if span_seconds is not None:
        return spaced(touches, by, ts, key, seconds, span_seconds, "accepted")

    def step(held, group: tuple, row: dict) -> tuple:
        last = held
        ok = last is None or (row[ts] - last).total_seconds() >= seconds
        return (row[ts] if ok else last), ok

    return fold_in_order(touches, by, [ts, key], step, "accepted", "boolean", uses=[ts])


# Weights of memory ranking, and card types in order of preference.
RANKING = {"semantic": 0.45, "keyword": 0.25, "graph": 0.10, "recency": 0.10, "importance": 0.05, "trust": 0.05}
RERANK_WEIGHT, RERANK_WINDOW, RECENCY_DAYS = 0.20, 50, 90
TYPE_ORDER = ("decision", "procedure", "fact", "episodic", "glossary")


def rank_memories(candidates: DataFrame, as_of: Column, key: str, when: str, rerank: Column | None = None) -> DataFrame:
    """candidates with ``score``: signals over their maxima, recency by half-life, importance and trust."""
    signals = ("semantic", "keyword", "graph")
    bounded = scoring.with_bounds(candidates, **{f"_{n}": n for n in signals})

    def over_max(name: str) -> Column:
        most = F.col(f"_{name}_high")
        return F.when(most > 0, F.col(name) / most).otherwise(F.lit(0.0))

    age = scoring.age_seconds(F.col(when), as_of) / 86400
    parts = {n: over_max(n) for n in signals}
    parts["recency"] = F.pow(F.lit(2.0), -age / RECENCY_DAYS)
    parts |= {n: F.col(n).cast("double") for n in ("importance", "trust")}
    total = F.lit(0.0)
    for name, weight in RANKING.items():
        total = total + parts[name] * weight
    out = bounded.select(*candidates.columns, F.round(total, 6).alias("score"))
    if rerank is None:
        return out
    # The window's rows are few, so they go to the others by a broadcast.
    head = out.orderBy(F.desc("score"), key).limit(RERANK_WINDOW).select(key, rerank.alias("_r"))
    most = head.agg(F.max("_r").alias("_most"))
    joined = out.join(F.broadcast(head), key, "left").join(F.broadcast(most))
    share = F.when(F.col("_most") > 0, F.coalesce("_r", F.lit(0.0)) / F.col("_most")).otherwise(F.lit(0.0))
    return joined.withColumn("score", F.round(F.col("score") + RERANK_WEIGHT * share, 6)).drop("_r", "_most")


def pack(
    rows: DataFrame, key: str, kind: str, tokens: str, cards: int = 8, budget: int = 1200, per_kind: int = 2
) -> DataFrame:
    """``(key, position, tokens)``: greedy packing in score order.

    A type that has its cards is skipped; the first card over the budget ends the
    packing. Skips don't use budget, so this isn't a running sum. Only the first
    ``per_kind`` of a type can ever be taken, so the list is cut to those before
    one small group is folded.
    """
    order = F.array(*map(F.lit, TYPE_ORDER))
    rank = F.when(F.array_position(order, F.col(kind)) > 0, F.array_position(order, F.col(kind))).otherwise(
        len(TYPE_ORDER) + 1
    )
    w = Window.partitionBy(kind).orderBy(F.desc("score"), key)
    head = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_kind)
    w_all = Window.orderBy(F.desc("score"), "_rank", key)
    listed = head.withColumn("_rank", rank).withColumn("_at", F.row_number().over(w_all))
    # Without the capped types, what is left is taken until the first overflow or the last card.
    running = F.sum(tokens).over(Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    taken = listed.withColumn("_sum", running).where((F.col("_sum") <= budget) & (F.col("_at") <= cards))
    return taken.select(key, F.col("_at").alias("position"), F.col(tokens))


#: Nodes that an expansion visits at most (fixed value).
MOST_NODES = 200


def entity_ids(entities: DataFrame, namespace: str, names: Sequence[str]) -> DataFrame:
    """``(node)`` of the entities of a namespace that have one of some names."""
    hit = (F.col("namespace") == namespace) & F.col("name").isin(*names)
    return entities.where(hit).select(F.col("entity_id").alias("node")).distinct()


def expand(edges: DataFrame, start: DataFrame, depth: int = 2, node: str = "node", most: int = MOST_NODES) -> DataFrame:
    """``(node, depth)`` of what ``depth`` steps along edges ``(src, dst, relation, weight)`` reach.

    Edges are followed from src to dst. A step visits new nodes by relation, falling
    weight and id, and visiting ends at ``most`` nodes, start included; the node that
    reaches the bound is still visited. With ``most`` start nodes or more only the first
    new node is. A step's nodes are ``most`` at most, so they are held on the driver and
    go to the scan of the edges as a condition.
    """
    begin = start.select(F.col(node).alias("node")).distinct()
    held = [r[0] for r in begin.limit(most + 1).collect()]
    kind = begin.schema["node"].dataType.simpleString()
    few = len(held) <= most
    seen, found = set(held), []
    if not few:  # too many to hold: the bound is reached with the first new node
        depth = min(depth, 1)
    for k in range(1, depth + 1):
        met = edges.where(F.col("src").isin(*held)) if few else edges.join(begin, edges["src"] == begin["node"], "left_semi")
        order = F.min(F.struct("relation", (-F.col("weight")).alias("minus"))).alias("o")
        first = met.groupBy(F.col("dst").alias("node")).agg(order)
        first = first.where(~F.col("node").isin(*seen)) if few else first.join(begin, "node", "left_anti")
        room = max(1, most - len(seen)) if few else 1
        step = [r["node"] for r in first.orderBy("o", "node").limit(room).collect()]
        found += [(n, k) for n in step]
        seen |= set(step)
        held = step
        if not step or len(seen) >= most:
            break
    spark = edges.sparkSession
    visited = spark.createDataFrame(found, f"node {kind}, depth int")
    return begin.withColumn("depth", F.lit(0)).unionByName(visited)


def keyword_fallback(items: DataFrame, query: str, key: str, content: str, limit: int) -> DataFrame:
    """``(key, score)``: how many of a query's words occur in an item's text, best first; at least one."""
    words = [w.lower() for w in query.split()]
    low = F.lower(F.coalesce(content, F.lit("")))
    score = F.lit(0.0)
    for word in words:
        score = score + F.contains(low, F.lit(word)).cast("double")
    return items.select(key, score.alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(limit)


def gather(signals: Mapping[str, tuple[DataFrame, str]], key: str) -> DataFrame:
    """``(key, <signal> ..., reasons)`` of candidates of any signal: each signal's best score and why it was found.

    Signals are ``name: ((key, score) rows, reason)``; one shuffle serves all of them.
    """
    rows = None
    for name, (hits, reason) in signals.items():
        one = hits.select(key, F.lit(name).alias("signal"), F.col("score").cast("double").alias("score"), F.lit(reason).alias("reason"))
        rows = one if rows is None else rows.unionByName(one)
    best = (F.coalesce(F.max(F.when(F.col("signal") == n, F.col("score"))), F.lit(0.0)).alias(n) for n in signals)
    return rows.groupBy(key).agg(*best, F.array_sort(F.collect_set("reason")).alias("reasons"))


def linked_items(links: DataFrame, items: DataFrame, nodes: DataFrame, item: str) -> DataFrame:
    """``(item, score)`` of items that any of some nodes is linked with, each once, score 1."""
    met = links.join(nodes, links["entity_id"] == nodes["node"], "left_semi").select(item).distinct()
    return items.join(met, item, "left_semi").select(item, F.lit(1.0).alias("score"))


def policy_filter(
    rows: DataFrame, as_of: Column, statuses: Sequence[str], most_sensitive: int, audiences: Sequence[str]
) -> DataFrame:
    """Rows that a reader may see: state, sensitivity, validity and audience."""
    now = as_of
    return rows.where(
        F.col("status").isin(*statuses)
        & (F.col("sensitivity") <= most_sensitive)
        & (F.col("valid_from").isNull() | (F.col("valid_from") <= now))
        & (F.col("valid_to").isNull() | (F.col("valid_to") > now))
        & F.arrays_overlap("audiences", F.array(*map(F.lit, audiences)))
    )


def span_query(hits: DataFrame, as_of_newest: str, key: str, content: str, k: int = 8) -> DataFrame:
    """Memory span search: lexical score mixed with age against the newest hit, one row per content."""
    newest = scoring.with_bounds(hits, _at=as_of_newest)
    age = (F.unix_micros("_at_high") - F.unix_micros(as_of_newest)) / 1e6 / 86400
    score = F.round(0.85 * F.col("lexical") + 0.15 * F.pow(F.lit(2.0), -age / 30), 6)
    scored = newest.withColumn("score", score).drop("_at_low", "_at_high")
    w = Window.partitionBy(content).orderBy(F.desc("score"), key)
    once = scored.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return once.orderBy(F.desc("score"), key).limit(min(k, 24))
