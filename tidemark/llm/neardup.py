"""Near-duplicate documents by SuperMinHash signatures.

A document's set holds its distinct shingles of ``shingle`` lower-cased (A-Z
only) words; a document with fewer words has its whole word sequence as one
shingle, one without words has the empty set. Two documents are linked when
``100 * |A & B| >= percent * |A | B|``.

1. *Signatures.* Each shingle draws a pseudo-random permutation of the signature
   positions; at step j it offers ``j + r`` (r in [0, 1)) to its j-th position,
   and each position keeps its least offer. Since step j offers nothing below j,
   a document stops as soon as all its positions hold less than the next step.
   Ranks of one shingle are thus correlated over positions, which lowers the
   variance against independent minima.
2. *Copies.* Documents with the same set (128-bit sum of shingle hashes, and its
   size) become one class, represented by its smallest id.
3. *Banding.* Classes that agree on all rows of a band share a bucket. Rows and
   bands follow from the threshold so that a pair right at it is missed with
   a probability of 1e-6 at most.
4. *Verification.* In each bucket every member is compared with its most central
   one, so a bucket of n costs n comparisons. Buckets that are then not within
   one component go on: those of few members compare what is still apart. In larger
   ones the members outside the largest component, the *strays*, are compared with
   all members: while they are many, first with the most central stray, which
   gathers them. Then strays go of whose shingles too few are anyone else's in the group
   (documents that share a passage and nothing more), and the others are compared exactly
   in blocks, by products of matrices that emit nothing but links between components.
   Members of the largest component aren't compared with each other again, so n near
   copies and some strays cost about n. A comparison looks at sizes first, then at the
   full sets.
5. *Grouping.* Verified links go through union-find (:mod:`.components`).

Texts are read twice: for all signatures, and for the full sets of one document of each
class that shares a bucket.

Edge cases: null or empty texts and texts without words have an empty set and
are linked with nothing; a null id is linked with nothing, has a null component
and is kept; rows that repeat an id are grouped each by its own text; ties between representatives go to the smaller id; an empty table
gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, column, discard, materialise, mix64, session_of, text_chunks, word_hashes
from .components import UnionFind, connected

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)

#: Rows in a signature at most (positions are held in bytes).
SIGNATURE_ROWS = 128
#: Chance of missing a pair right at the threshold in banding.
MISS = 1e-6
#: Buckets of more members than this are compared in blocks.
SMALL_BUCKET = 32
#: Members and shingles in a block of a larger one, about.
BLOCK_MEMBERS, BLOCK_ITEMS = 512, 150_000
#: Strays in a group that are too many for comparing all at once, and rounds that gather them at most.
MANY_STRAYS, GATHERING_ROUNDS = 2048, 4
#: Candidate ids that are broadcast to the text scan at most (8 bytes each).
BROADCAST_IDS = 500_000
#: Shingles of one signature step, and documents, that are handled together.
_SLICE, _SLICE_DOCS = 16_384, 256


def banding(threshold: float, rows_at_most: int = SIGNATURE_ROWS) -> tuple[int, int]:
    """(bands, rows): the longest bands that still keep to MISS at the threshold."""
    for rows in range(12, 1, -1):
        bands = rows_at_most // rows
        if (1 - threshold**rows) ** bands <= MISS:
            return bands, rows
    return rows_at_most, 1


def shingle_sets(texts: list[str], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of all texts in order, and each text's count."""
    raw = [x.encode("utf-8").translate(ASCII_LOWER) for x in texts]
    words, counts = word_hashes(raw)
    places = mix64(np.arange(1, shingle + 2, dtype=np.uint64)) | _U(1)
    if len(words) >= shingle:
        mixed = words[: len(words) - shingle + 1] * places[0]
        for k in range(1, shingle):
            mixed += words[k : len(words) - shingle + 1 + k] * places[k]
        mixed = mix64(mixed)
    else:
        mixed = np.empty(0, np.uint64)
    sets, at = [], 0
    for n in counts.tolist():
        if n >= shingle:
            own = np.sort(mixed[at : at + n - shingle + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            sets.append(own[keep])
        elif n:
            parts = np.append(words[at : at + n] * places[:n], places[shingle : shingle + 1] * _U(n))
            sets.append(mix64(parts.sum(keepdims=True)))
        else:
            sets.append(np.empty(0, np.uint64))
        at += n
    sizes = np.array([len(x) for x in sets], np.int64)
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), sizes


def superminhash(items: np.ndarray, sizes: np.ndarray, m: int) -> np.ndarray:
    """(sets, m) signatures of consecutive sets of hashes; rows of empty sets stay at the maximum.

    A value holds the step in its upper and the draw in its lower 32 bits.
    """
    out = np.full((len(sizes), m), np.iinfo(np.uint64).max, np.uint64)
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        begin = int(ends[first] - sizes[first])
        last = int(np.searchsorted(ends, begin + _SLICE, "right"))
        last = max(first + 1, min(last, first + _SLICE_DOCS))
        rows = out[first:last]
        owner = np.repeat(np.arange(last - first), sizes[first:last])
        own = items[begin : int(ends[last - 1])]
        for at in range(0, len(own), _SLICE):  # more than one slice: one very long document
            _offer(rows, own[at : at + _SLICE], owner[at : at + _SLICE], m)
        first = last
    return out


def _offer(rows: np.ndarray, items: np.ndarray, owner: np.ndarray, m: int) -> None:
    """Let the shingles of some documents make their offers, stopping documents early."""
    order = np.tile(np.arange(m, dtype=np.uint8), (len(items), 1))
    flat = rows.reshape(-1)
    for j in range(m):
        drawn = mix64(items + _U((j + 1) * int(_STEP) & (1 << 64) - 1))
        pick = ((drawn >> _U(32)) * _U(m - j) >> _U(32)).astype(np.int64) + j
        each = np.arange(len(items))
        place = order[each, pick]
        order[each, pick] = order[:, j]
        np.minimum.at(flat, owner * m + place, _U(j << 32) | (drawn & _U(0xFFFFFFFF)))
        going = rows.max(axis=1) >= _U((j + 1) << 32)
        stay = going[owner]
        left = int(np.count_nonzero(stay))
        if not left:
            return
        if left < len(items):
            items, owner, order = items[stay], owner[stay], order[stay]


def signatures(
    docs: DataFrame, shingle: int, bands: int, rows: int, key: str, text: str
) -> DataFrame:
    """``(id, n, f1, f2, buckets array<long>)`` for every row of docs."""
    session_of(docs)
    m = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches, 1):
            items, sizes = shingle_sets(texts, shingle)
            sig = superminhash(items, sizes, m)
            full = np.flatnonzero(sizes)
            ends = np.cumsum(sizes)
            prints = []
            for salt in (1, 2):
                total = np.concatenate([[_U(0)], np.cumsum(mix64(items ^ mix64(np.array([salt], np.uint64))))])
                prints.append((total[ends] - total[ends - sizes]).astype(np.int64))
            mixed = mix64(sig)
            keys = np.zeros((len(sizes), bands), np.uint64)
            for k in range(rows):
                keys = mix64(keys + mixed[:, k::rows])
            keys = mix64(keys + _STEP * np.arange(1, bands + 1, dtype=np.uint64)).astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum((sizes > 0) * bands)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).cast(pa.int64()),
                    pa.array(sizes),
                    pa.array(prints[0]),
                    pa.array(prints[1]),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[full].reshape(-1))),
                ],
                ["id", "n", "f1", "f2", "buckets"],
            )

    out = "id long, n long, f1 long, f2 long, buckets array<long>"
    return docs.select(column(key), column(text)).mapInArrow(run, out)


def full_sets(docs: DataFrame, ids: DataFrame, shingle: int, key: str, text: str) -> DataFrame:
    """``(id, items array<long>)``: full shingle sets of the documents in ids (distinct, one column)."""
    wanted = _bounded(ids.toDF("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches, 1):
            items, sizes = shingle_sets(texts, shingle)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(items.astype(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), lists], ["id", "items"]
            )

    chosen = docs.select(column(key).alias("id"), column(text).alias("text")).join(wanted, "id", "left_semi")
    sets = chosen.mapInArrow(run, "id long, items array<long>")
    # Rows that repeat an id and a text have one set between them.
    once = sets.withColumn("h", F.xxhash64("items")).groupBy("id", "h").agg(F.first("items").alias("items"))
    return once.drop("h")


def _fitting(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The distinct (a, b) pairs that sizes don't rule out."""
    left = reps.select(F.col("id").alias("a"), F.col("n").alias("na"))
    right = reps.select(F.col("id").alias("b"), F.col("n").alias("nb"))
    near = (
        pairs.join(left, "a")
        .join(right, "b")
        .where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    )
    return near.select("a", "b").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(k) for k in (2, 3))
            av, bv = (x.flatten().to_numpy(zero_copy_only=False) for x in (a, b))
            ao, bo = (np.asarray(x.offsets) - x.offsets[0].as_py() for x in (a, b))
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = av[ao[i] : ao[i + 1]], bv[bo[i] : bo[i + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = both * 100 >= percent * (len(x) + len(y) - both)
            yield batch.select([0, 1]).filter(pa.array(keep))

    left = sets.select(F.col("id").alias("a"), F.col("items").alias("ia"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("ib"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .select("a", "b", "ia", "ib")
        .mapInArrow(run, "a long, b long")
        .distinct()
    )


def _within_small(members: DataFrame, percent: int) -> DataFrame:
    """Pairs across components within buckets of SMALL_BUCKET members at most, size permitting."""
    other = F.struct("id", "root", "n")
    rows = members.groupBy("bucket").agg(F.sort_array(F.collect_list(other)).alias("all"))
    one = rows.select("all", F.posexplode("all").alias("at", "x"))
    two = one.select(
        F.col("x.id").alias("a"),
        F.explode(
            F.expr(
                "filter(slice(all, at + 2, size(all)), y -> y.root <> x.root and "
                f"least(y.n, x.n) * 100 >= greatest(y.n, x.n) * {percent})"
            )
        ).alias("y"),
    )
    return two.select("a", F.col("y.id").alias("b")).distinct()


def _able(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """members without strays that can't be linked: fewer of their shingles than a link needs are anyone else's in the group.

    Sets are cut into ranges of hashes, as many as a group's shingles take, and each range of
    a group counts on its own which shingles occur again. The members of the largest
    component go as one set for each batch, since only what they hold matters.
    """
    whole = members.join(sets, "id")
    parts = F.ceil(F.sum(F.size("items")) / BLOCK_ITEMS).cast("int").alias("parts")
    sizes = materialise(whole.groupBy("pivot").agg(parts))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivots, strays, ranges = (np.asarray(batch.column(k).to_numpy(zero_copy_only=False)) for k in (0, 2, 3))
            rows: list[tuple] = []
            for pivot in np.unique(pivots):
                own = np.flatnonzero(pivots == pivot)
                n_ranges, others = int(ranges[own[0]]), []
                for i in own:
                    items = np.asarray(batch.column(4)[i].values).view(np.uint64)
                    if strays[i]:
                        name = batch.column(1)[i].as_py()
                        rows += [(int(pivot), r, name, len(items), x, x[:0]) for r, x in _ranges(items, n_ranges)]
                    else:
                        others.append(items)
                if others:
                    seen, times = np.unique(np.concatenate(others), return_counts=True)
                    again = dict(_ranges(seen[times > 1], n_ranges))
                    rows += [(int(pivot), r, None, 0, x, again.get(r, x[:0])) for r, x in _ranges(seen, n_ranges)]
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, k) for c, k in zip(columns, kinds)), *map(_hash_lists, columns[4:])],
                ["pivot", "part", "id", "n", "items", "twice"],
            )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = batch.column(1)[i].values
                names, sizes_, items, twice = (rows.field(k) for k in range(4))
                every = np.concatenate([np.asarray(x.flatten()) for x in (items, twice)])
                found, times = np.unique(every, return_counts=True)
                shared = np.isin(np.asarray(items.flatten()), found[times > 1])
                upto = np.concatenate([[0], np.cumsum(shared)])
                ends = np.asarray(items.offsets) - items.offsets[0].as_py()
                common = pa.array(upto[ends[1:]] - upto[ends[:-1]], pa.int64())
                out = [pa.array([batch.column(0)[i].as_py()] * len(names), pa.int64()), names, sizes_, common]
                yield pa.RecordBatch.from_arrays(out, ["pivot", "id", "n", "k"]).filter(names.is_valid())

    dealt = whole.join(_bounded(sizes), "pivot").select("pivot", "id", "stray", "parts", "items")
    dealt = dealt.mapInArrow(cut, "pivot long, part int, id long, n long, items array<long>, twice array<long>")
    cells = dealt.groupBy("pivot", "part").agg(F.collect_list(F.struct("id", "n", "items", "twice")).alias("all"))
    common = cells.select("pivot", "all").mapInArrow(counted, "pivot long, id long, n long, k long")
    able = common.groupBy("pivot", "id").agg(F.sum("k").alias("k"), F.first("n").alias("n"))
    able = able.where(F.col("k") * 100 >= F.col("n") * percent).select("pivot", "id")
    strays = members.where("stray").join(able, ["pivot", "id"], "left_semi")
    out = materialise(members.where("not stray").unionByName(strays.select(*members.columns)))
    discard(sizes)
    return out


def _ranges(items: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """Sorted hashes as ``(range, hashes)`` for those of n equal ranges of hashes that have some."""
    at = ((items >> _U(32)) * _U(n) >> _U(32)).astype(np.int64)
    found, first = np.unique(at, return_index=True)
    return list(zip(found.tolist(), np.split(items, first[1:]))) if len(items) else []


def _hash_lists(rows: tuple) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    flat = np.concatenate([np.empty(0, np.uint64), *rows]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _stray_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between strays and any members of other components, exact on full sets.

    ``members`` has ``(pivot, id, root, stray)`` rows. The strays and the others of a group
    are dealt into blocks of a bounded number of members and shingles, and each block of
    strays with itself and with every other block is one small piece of work: shingles
    that only one member of the two has can't be shared; members with too many of those
    are out; for the rest one product of matrices gives all overlaps. Out come the
    links that a union-find needs, not pairs.
    """
    lengths = members.join(sets.select("id", F.size("items").alias("n")), "id")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_MEMBERS), F.ceil(F.sum("n") / BLOCK_ITEMS)).cast("int")
    each = lengths.groupBy("pivot", "stray").agg(blocks.alias("blocks"))
    of = lambda stray: F.coalesce(F.max(F.when(F.col("stray") == stray, F.col("blocks"))), F.lit(0))
    sizes = materialise(each.groupBy("pivot").agg(of(True).alias("strays"), of(False).alias("others")))
    # One row for each group: within its bound it is broadcast, so that sets aren't dealt by group.
    dealt = members.join(_bounded(sizes), "pivot").where("strays > 0").join(sets, "id")
    at = F.xxhash64("id")
    dealt = dealt.withColumn(
        "mine",
        F.when(F.col("stray"), F.pmod(at, "strays")).otherwise(F.col("strays") + F.pmod(at, "others")).cast("int"),
    )
    upto = F.when(F.col("stray"), F.col("strays") + F.col("others")).otherwise(F.col("strays")) - 1
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), upto)))
    work = dealt.groupBy("pivot", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")).agg(
        F.collect_list(F.struct("id", "root", "items")).alias("all")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = batch.column(0)[i].values
                yield _linked(*(rows.field(k) for k in range(3)), percent)

    out = materialise(work.select("all").mapInArrow(run, "a long, b long"))
    discard(sizes)
    return out


def _linked(ids: pa.Array, roots: pa.Array, items: pa.Array, percent: int) -> pa.RecordBatch:
    """Links between some documents that connect their components, from their full sets."""
    ids, roots = np.asarray(ids), np.asarray(roots)
    sizes = np.diff(np.asarray(items.offsets))
    _, token, df = np.unique(np.asarray(items.flatten()), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(ids)), sizes)
    shared = df[token] > 1
    common = np.bincount(owner[shared], minlength=len(ids))
    able = (common * 100 >= percent * sizes) & (sizes > 0)
    keep = shared & able[owner]
    rows = np.cumsum(able) - 1
    d = int(able.sum())
    overlap = np.zeros((d, d), np.float32)
    _, token = np.unique(token[keep], return_inverse=True)
    order = np.argsort(token, kind="stable")
    row, token = rows[owner[keep]][order], token[order]
    width = max(1, 4_000_000 // max(1, d))  # columns of the product taken at a time
    for low in range(0, int(token[-1]) + 1 if len(token) else 0, width):
        at = slice(*np.searchsorted(token, [low, low + width]))
        x = np.zeros((d, width), np.float32)
        x[row[at], token[at] - low] = 1
        overlap += x @ x.T
    n, root, name = sizes[able].astype(np.float64), roots[able], ids[able]
    # Overlaps are whole numbers that single precision holds; the comparison needs double.
    linked = overlap.astype(np.float64) * (100 + percent) >= percent * (n[:, None] + n[None, :])
    a, b = np.nonzero(np.triu(linked & (root[:, None] != root[None, :]), 1))
    sets, out = UnionFind(), ([], [])
    for x, y in zip(a.tolist(), b.tolist()):
        if sets.find(int(root[x])) != sets.find(int(root[y])):
            sets.union(int(root[x]), int(root[y]))
            out[0].append(int(name[x]))
            out[1].append(int(name[y]))
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])


def near_duplicates(
    docs: DataFrame,
    percent: int = 80,
    shingle: int = 5,
    key: str = "doc_id",
    text: str = "text",
    work: dict | None = None,
) -> DataFrame:
    """``(key, n_shingles, component_id, kept)`` for every row of docs.

    ``component_id`` is the smallest id that links lead to, itself included. ``work``
    gets the number of ``pairs`` of documents that were compared.
    """
    return _grouped(docs, percent, shingle, key, text, work)[0]


def _grouped(
    docs: DataFrame, percent: int, shingle: int, key: str, text: str, work: dict | None = None
) -> tuple[DataFrame, list[DataFrame]]:
    """What near_duplicates returns, and the materialised frames that it reads."""
    bands, rows = banding(percent / 100)
    sigs = materialise(signatures(docs, shingle, bands, rows, key, text))
    reps = materialise(
        sigs.where("n > 0 and id is not null")
        .groupBy("f1", "f2", "n")
        .agg(F.min(F.struct("id", "buckets")).alias("r"))
        .select("f1", "f2", "n", "r.id", "r.buckets")
    )
    exploded = reps.select("id", "n", F.explode("buckets").alias("bucket"))
    # Tables by bucket are written before they are joined: a join with rows that an aggregate has just
    # dealt out by bucket would keep a very large bucket in one task, where one that deals both sides
    # out anew is split by adaptive execution.
    shared = materialise(exploded.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1"))
    sharing = materialise(exploded.join(shared, "bucket"))
    central = materialise(sharing.groupBy("id").agg(F.sum(F.log2("c")).alias("weight")))
    pivots = materialise(
        sharing.join(central, "id")
        .groupBy("bucket")
        .agg(F.max(F.struct("weight", (-F.col("id")).alias("minus"))).alias("p"))
        .select("bucket", F.col("p.weight").alias("weight"), (-F.col("p.minus")).alias("pivot"))
    )
    members = materialise(sharing.join(pivots, "bucket"))
    sets = materialise(full_sets(docs, central.select("id"), shingle, key, text))
    discard(shared, sharing, pivots)

    def links_of(pairs: DataFrame) -> DataFrame:
        near = materialise(_fitting(pairs, reps, percent))
        if work is not None:
            work["pairs"] = work.get("pairs", 0) + near.count()
        out = materialise(_verified(near, sets, percent))
        discard(near)
        return out

    links = links_of(_ordered(members.where("id <> pivot"), "id", "pivot"))
    star = connected(links)
    rooted = materialise(
        members.join(star.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    )
    apart = materialise(
        rooted.groupBy("bucket")
        .agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
        .where("lo <> hi")
        .select("bucket")
    )
    open_ = materialise(rooted.where("c > 2").join(apart, "bucket", "left_semi"))
    discard(rooted, apart)
    late = links_of(_within_small(open_.where(F.col("c") <= SMALL_BUCKET), percent))
    large = open_.where(F.col("c") > SMALL_BUCKET)
    # The large buckets of one group of copies differ by band; each goes under the most central
    # document that its members know from any bucket, so the group is worked on once.
    hub = F.max(F.struct("weight", (-F.col("pivot")).alias("minus"))).alias("hub")
    refs = large.select("id", "bucket").join(members.groupBy("id").agg(hub), "id")
    refs = materialise(refs.groupBy("bucket").agg((-F.max("hub")["minus"]).alias("pivot")))
    groups = materialise(large.drop("pivot").join(refs, "bucket").select("pivot", "id", "root").distinct())
    discard(refs, open_, members)
    if not groups.isEmpty():
        late = _united(late, _large_groups(groups, central, sets, links_of, percent, work))
    discard(groups, central, sets)
    if not late.isEmpty():
        every = links.union(late)
        discard(star)
        star = connected(every)
    discard(links, late)

    classes = reps.select("f1", "f2", "n", F.col("id").alias("rep"))
    classes = classes.join(star.withColumnRenamed("node", "rep"), "rep", "left").select(
        "f1", "f2", "n", F.coalesce("root", "rep").alias("component")
    )
    out = sigs.select("id", "n", "f1", "f2").join(classes, ["f1", "f2", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    out = out.select(
        F.col("id").alias(key),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )
    return out, [sigs, reps, star]


def _ordered(rows: DataFrame, one: str, other: str) -> DataFrame:
    """Distinct (a, b) with a < b."""
    return rows.select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b")).distinct()


def _united(one: DataFrame, other: DataFrame) -> DataFrame:
    """Both tables of links as one materialised table in their place."""
    out = materialise(one.union(other))
    discard(one, other)
    return out


def _large_groups(
    groups: DataFrame, central: DataFrame, sets: DataFrame, links_of, percent: int, work: dict | None
) -> DataFrame:
    """Links between components within ``(pivot, id, root)`` groups; ``central`` has each id's weight."""
    found = None
    for _ in range(GATHERING_ROUNDS):
        strays = materialise(_strays(groups, found).where("stray"))
        many = strays.groupBy("pivot").agg(F.count("*").alias("c")).where(F.col("c") > MANY_STRAYS).select("pivot")
        strays = materialise(strays.join(many, "pivot", "left_semi").join(central, "id"))
        if strays.isEmpty():
            discard(strays)
            break
        first = F.max(F.struct("weight", (-F.col("id")).alias("minus")))
        middle = materialise(strays.groupBy("pivot").agg((-first["minus"]).alias("middle")))
        more = links_of(_ordered(strays.join(middle, "pivot").where("id <> middle"), "id", "middle"))
        discard(strays, middle)
        none = more.isEmpty()
        found = more if found is None else _united(found, more)
        if none:
            break
    every = materialise(_strays(groups, found))
    marked = _able(every, sets, percent)
    discard(every)
    if work is not None:
        counts = marked.groupBy("pivot").agg(
            F.count_if("stray").alias("s"), F.count("*").alias("c")
        )
        work["pairs"] = work.get("pairs", 0) + (counts.agg(F.sum(F.col("s") * F.col("c"))).first()[0] or 0)
    late = _stray_links(marked, sets, percent)
    discard(marked)
    return late if found is None else _united(found, late)


def _strays(groups: DataFrame, found: DataFrame | None) -> DataFrame:
    """``(pivot, id, root, stray)``: whether a member is outside its group's largest component."""
    if found is not None and not found.isEmpty():
        # Links found meanwhile join the components that their ends were in.
        roots = groups.select("id", "root").distinct()
        ends = found.join(roots.toDF("a", "ra"), "a").join(roots.toDF("b", "rb"), "b")
        now = connected(ends.select("ra", "rb"))
        groups = groups.join(now.toDF("root", "now"), "root", "left")
        groups = groups.select("pivot", "id", F.coalesce("now", "root").alias("root"))
    sizes = groups.groupBy("pivot", "root").agg(F.count("*").alias("c"))
    main = sizes.groupBy("pivot").agg(F.max(F.struct("c", F.col("root").alias("main")))["main"].alias("main"))
    return groups.join(main, "pivot").select("pivot", "id", "root", (F.col("root") != F.col("main")).alias("stray"))


def without_near_duplicates(
    docs: DataFrame, percent: int = 80, shingle: int = 5, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One document of each group of near duplicates, with all columns of docs.

    The representative of a group stays; rows that repeat an id and a text are one
    document; rows with a null id stay.
    """
    grouped, frames = _grouped(docs, percent, shingle, key, text)
    groups = materialise(grouped.select(F.col(key).alias("id"), "kept"))
    discard(*frames)
    each = groups.where("id is not null").groupBy("id")
    by_id = materialise(each.agg(F.bool_or("kept").alias("any"), F.count("*").alias("rows")))
    discard(groups)
    every = [column(c) for c in docs.columns]
    gone, repeated = (by_id.where(x).select(F.col("id").alias(key)) for x in ("not any", "rows > 1 and any"))
    out = docs.join(_bounded(gone), key, "left_anti").select(*every)
    if repeated.isEmpty():
        return out
    repeated = _bounded(repeated)
    single = out.join(repeated, key, "left_anti").select(*every)
    several = out.join(repeated, key, "left_semi").select(*every)
    return single.union(several.dropDuplicates([key, text]))


def _bounded(ids: DataFrame) -> DataFrame:
    """ids with a broadcast hint if they are BROADCAST_IDS at most."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
