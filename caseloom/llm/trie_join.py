"""Documents linked by the Jaccard similarity of their word n-grams, joined over prefix trees; exact.

1. Documents with equal sets are one class; only one of each goes on.
2. All n-grams have one global order, from rare to frequent. Two sets that are similar enough share several n-grams
   among the first of each. Those are sorted by n-gram and set size; sets that stand together there are counted, by
   pairs where they are few, by set where they are many. Pairs that share too few are left out, and the connected
   parts of what remains are the families that can hold links.
3. A family is cut into blocks of bounded size, and pairs of blocks that sizes allow are joined, one pair a
   task: the sets of one block stand in a prefix tree, most frequent n-gram first; the tree is walked once for all sets
   of the other block together, their partial overlaps are shared by all sets below a node, and a set leaves a subtree
   as soon as the lengths that remain cannot give the overlap needed.
4. Links found are counted per class and their connected components are taken in Spark.

Where only the components are asked for, a large family is not compared pair by pair: some of its sets, the pivots, are
compared with all of it first, in rounds, and sets that they connect are one part. Blocks of one large part do not
meet; only what no pivot has connected is compared with the rest of its family.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.common import components, for_python, small_frame, stored

#: Words per n-gram and the similarity that links, as shared parts of the whole.
SHINGLE, SHARED, OF = 5, 8, 10
#: The order is by counts of hashed n-grams in so many (2 to this power) counters; their number does not grow.
COUNTER_BITS = 18
#: A block of a family: at most about so many sets and n-grams in all.
BLOCK_SETS = 512
BLOCK_SHINGLES = 200_000
#: A set must share one of its first n-grams, and one more for each so many members.
MEMBERS_PER_SHARE = 20
#: Up to so many sets that share an n-gram are counted by pairs.
PAIRED_SETS = 4
#: Texts whose n-grams a Python worker holds at a time.
PIECE_ROWS = 500
#: Rows that may go to every task.
BROADCAST_ROWS = 200_000
#: Sets of a large family that are compared with all of it, and how often others are chosen for what they leave.
PIVOTS = 16
PIVOT_ROUNDS = 3
#: The part of the sets that no pivot has connected with more than a block of others.
OPEN = -1

_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows: a worker holds the sets of so many texts at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, PIECE_ROWS):
            yield batch.slice(start, PIECE_ROWS)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``size`` words, A-Z in lower case; all words as one run if they are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both know ASCII only, as wanted
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    length = min(n, size)
    runs = np.full(n - length + 1, length, np.uint64)
    for i in range(length):
        runs = _mixed(runs * _P[0] + hashes[i : i + len(runs)])
    return np.unique(runs)


def _signature(found: np.ndarray) -> tuple[int, int]:
    """Two numbers that tell sets apart, whatever the order of their members."""
    sums = [(_mixed(found * p + p).sum(dtype=np.uint64)).astype(np.int64) for p in _P[1:3]]
    return int(sums[0]), int(sums[1])


def _counts(read: DataFrame, size: int) -> np.ndarray:
    """How many n-grams of documents fall on each counter, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTER_BITS, np.int64)
        for batch in _pieces(batches):
            for text in batch.column("text").to_pylist():
                at = (shingle_set(text, size) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)
                if len(at) > 10_000:
                    total += np.bincount(at, minlength=len(total))
                else:
                    np.add.at(total, at, 1)
        places = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(places.astype(np.int32)), pa.array(total[places])], names=["at", "n"])

    rows = for_python(read).select("text").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(1 << COUNTER_BITS, np.int64)
    total[rows.column("at").to_numpy()] = rows.column("n").to_numpy()
    return total


class GlobalOrder:
    """A total order of n-grams: by the level of their counter, rare first, then by hash."""

    def __init__(self, counts: np.ndarray):
        self.levels = np.floor(2 * np.log2(counts + 1)).astype(np.uint8)

    def sorted(self, found: np.ndarray) -> np.ndarray:
        levels = self.levels[(found >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
        # Hashes come sorted, and the sort by level keeps their order.
        return found[np.argsort(levels, kind="stable")]


def overlap_needed(n: int, shared: int, of: int) -> int:
    """Members that a set of n shares at least with every set that is similar enough."""
    return -(-n * shared // of)


def prefix_length(n: int, shared: int, of: int) -> int:
    """Of its first so many members a set shares ``shares_needed`` with every set that is similar enough.

    With an overlap of o, the l-th common member in the order has at least o - l members of each set behind it, so it
    is among the first n - o + l of both.
    """
    overlap = overlap_needed(n, shared, of)
    return n - overlap + min(1 + n // MEMBERS_PER_SHARE, overlap)


def shares_of(n: Column, shared: int, of: int) -> Column:
    """For a set of n: how many of its first members ``prefix_length`` lets it share; of two sets the smaller number counts."""
    return F.least(F.floor(n / F.lit(MEMBERS_PER_SHARE)) + 1, F.ceil(n * shared / F.lit(of))).cast("long")


def shares_needed(n: Column, shared: int, of: int) -> Column:
    """The least that a set of n must share with any set that may be similar: the smallest such set decides."""
    return shares_of(F.ceil(n * shared / F.lit(of)).cast("long"), shared, of)


def _sets(read: DataFrame, size: int, order: GlobalOrder, shared: int, of: int) -> DataFrame:
    """``(doc_id, _key, n, c1, c2, first)`` of every row: set size, signature and the first n-grams of the order."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            sizes, ones, twos, firsts = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingle_set(text, size)
                one, two = _signature(found)
                sizes.append(len(found))
                ones.append(one)
                twos.append(two)
                firsts.append(order.sorted(found)[: prefix_length(len(found), shared, of)].view(np.int64) if len(found) else [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("_key"), pa.array(sizes, pa.int64()), pa.array(ones, pa.int64()),
                    pa.array(twos, pa.int64()), pa.array(firsts, pa.list_(pa.int64())),
                ],
                names=["doc_id", "_key", "n", "c1", "c2", "first"],
            )

    return for_python(read).mapInArrow(describe, "doc_id long, _key long, n long, c1 long, c2 long, first array<bigint>")


ORDER = ["gram", "n", "cls"]


def _allowed(grams, sizes, next_grams, next_sizes, shared: int, of: int):
    return (grams == next_grams) & (sizes * of >= next_sizes * shared)


def _together(rows: DataFrame, shared: int, of: int) -> DataFrame:
    """``(kind, gram, n, a, b)``: sets that stand together in the order of (n-gram, set size).

    Of up to ``PAIRED_SETS`` sets each pair ``(a, b)``, kind 1; of more each set ``a``, kind 2. Sets at the ends of
    a range count as more, as others may stand beside them in the next.
    """

    def out(kind: int, gram, n, a, b) -> pa.RecordBatch:
        columns = [np.full(len(a), kind), gram, n, a, b]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.asarray(c, np.int64)) for c in columns], names=["kind", "gram", "n", "a", "b"]
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows of the last run, which may go on; its first row is known already if the run is long.
        left, long, known = None, True, False
        for batch in batches:
            if not batch.num_rows:
                continue
            gram, n, cls = (batch.column(c).to_numpy() for c in ORDER)
            if left is not None:
                gram, n, cls = (np.concatenate([x, y]) for x, y in zip(left, (gram, n, cls)))
            good = _allowed(gram[:-1], n[:-1], gram[1:], n[1:], shared, of)
            run = np.concatenate([[0], np.cumsum(~good)])
            many = np.bincount(run) > PAIRED_SETS
            many[0] |= long
            many_rows, ends = many[run], run < run[-1]
            for step in range(1, PAIRED_SETS):
                i = np.flatnonzero((run[:-step] == run[step:]) & ~many_rows[:-step] & ends[:-step])
                i = i[n[i] * of >= n[i + step] * shared]
                yield out(1, gram[i], n[i], cls[i], cls[i + step])
            long = bool(many[-1])
            told = many_rows & (ends | long)
            told[0] &= not known
            yield out(2, gram[told], n[told], cls[told], cls[told])
            # Without an end in this batch the first run is the last one too.
            keep = np.array([len(run) - 1]) if long else np.flatnonzero(~ends)
            left, known = (gram[keep], n[keep], cls[keep]), long
        if left is not None and not known:
            yield out(2, *left, left[2])

    return rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(
        count, "kind long, gram long, n long, a long, b long"
    )


def _chained(rows: DataFrame, shared: int, of: int) -> DataFrame:
    """``(a, b)``: sets next to each other in the order, if one n-gram and sizes allow a link.

    Sorted by ranges, so that a frequent n-gram is spread over tasks; the driver joins the ends of the ranges.
    """

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None

        def out(kind, gram, n, a, b) -> pa.RecordBatch:
            columns = [np.full(len(a), part), np.full(len(a), kind), gram, n, a, b]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.asarray(c, np.int64)) for c in columns], names=["part", "kind", "gram", "n", "a", "b"]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            gram, n, cls = (batch.column(c).to_numpy() for c in ORDER)
            if last is None:
                yield out(0, gram[:1], n[:1], cls[:1], cls[:1])
            else:
                gram, n, cls = (np.concatenate([[x], y]) for x, y in zip(last, (gram, n, cls)))
            good = _allowed(gram[:-1], n[:-1], gram[1:], n[1:], shared, of)
            yield out(1, gram[1:][good], n[1:][good], cls[:-1][good], cls[1:][good])
            last = (gram[-1], n[-1], cls[-1])
        if last is not None:
            yield out(2, *([x] for x in last), [last[2]])

    found = stored(
        rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
        .mapInArrow(link, "part long, kind long, gram long, n long, a long, b long"),
        "chained",
    )
    ends = sorted(found.where(F.col("kind") != 1).collect(), key=lambda r: (r["part"], r["kind"]))
    joined = [
        (x["a"], y["a"]) for x, y in zip(ends, ends[1:])
        if x["kind"] == 2 and y["kind"] == 0 and _allowed(x["gram"], x["n"], y["gram"], y["n"], shared, of)
    ]
    links = found.where(F.col("kind") == 1).select("a", "b").distinct()
    return links.unionByName(small_frame(rows.sparkSession, joined, "a long, b long"))


def _candidates(classes: DataFrame, shared: int, of: int) -> DataFrame:
    """``(a, b)``: links that connect all classes that may be similar, and few others.

    Two similar classes share ``shares_of`` of their first n-grams. They stand there as a counted pair, or both among
    many: the pairs counted and the lesser of both numbers among many must add up to that.
    """
    found = stored(_together(classes.select(F.explode("first").alias("gram"), "n", "cls"), shared, of), "together")
    pairs = found.where(F.col("kind") == 1).groupBy("a", "b").agg(F.count(F.lit(1)).alias("pairs"))
    many = found.where(F.col("kind") == 2).select(F.col("a").alias("cls"), "gram", "n")
    among = many.groupBy("cls").agg(F.count(F.lit(1)).alias("many"))
    known = stored(
        classes.select("cls", "n").join(among, "cls", "left").select("cls", "n", F.coalesce("many", F.lit(0)).alias("many")),
        "known",
    )
    for end in ("a", "b"):
        pairs = pairs.join(known.select(*(F.col(c).alias(f"{c}_{end}") for c in ("cls", "n", "many"))), F.col(end) == F.col(f"cls_{end}"))
    needed = F.least(shares_of(F.col("n_a"), shared, of), shares_of(F.col("n_b"), shared, of))
    close = pairs.where(F.col("pairs") + F.least("many_a", "many_b") >= needed).select("a", "b")
    # Pairs that never stand together among few must reach their number among many alone.
    busy = known.where(F.col("many") >= shares_needed(F.col("n"), shared, of)).select("cls")
    return close.unionByName(_chained(many.join(busy, "cls", "left_semi").select(*ORDER), shared, of))


def _blocks() -> Column:
    """Blocks for so many sets, by their number and by the n-grams they hold."""
    return F.greatest(
        F.ceil(F.col("_sets") / BLOCK_SETS), F.least(F.col("_sets"), F.ceil(F.col("_grams") / BLOCK_SHINGLES))
    ).cast("int")


def _sizes(members: DataFrame, *keys: str) -> DataFrame:
    return members.groupBy(*keys).agg(F.count(F.lit(1)).alias("_sets"), F.sum("n").alias("_grams"))


def _cell(*columns: Column) -> Column:
    names = ("low_band", "low_part", "low", "high_band", "high_part", "high", "side")
    return F.struct(*[c.alias(name) for name, c in zip(names, columns)])


def _cells(members: DataFrame, shared: int, of: int) -> DataFrame:
    """``members (…, root, part)`` with the block pairs each takes part in: ``(…, cell struct)``.

    Sets that may be similar lie in one class of sizes or in neighbouring ones. A small family is one cell. Blocks
    of the open part meet each other and those of all other parts; blocks of another part do not meet their own.
    """
    small = (F.col("_sets") <= BLOCK_SETS) & (F.col("_grams") <= BLOCK_SHINGLES)
    step = math.log(of / shared)
    banded = members.join(_sizes(members, "root"), "root").withColumn(
        "band", F.when(small, F.lit(0)).otherwise(F.floor(F.log(F.col("n").cast("double")) / step + 1e-9).cast("int"))
    ).drop("_sets", "_grams")
    place = ["root", "part", "band"]
    bands = stored(_sizes(banded, *place).select(*place, _blocks().alias("k")), "bands")
    others = bands.select("root", F.col("part").alias("part2"), F.col("band").alias("band2"), F.col("k").alias("k2"))
    meet = (F.abs(F.col("band") - F.col("band2")) <= 1) & ((F.col("part") != F.col("part2")) | (F.col("part") == OPEN))
    partners = bands.join(others, "root").where(meet)
    placed = banded.join(partners, place).withColumn("i", F.pmod(F.xxhash64("cls"), F.col("k")).cast("int"))
    placed = placed.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k2") - 1)))
    mine, other = [F.col(c) for c in ("band", "part", "i")], [F.col(c) for c in ("band2", "part2", "j")]
    first = F.struct(*[c.alias(f"c{at}") for at, c in enumerate(mine)]) <= F.struct(
        *[c.alias(f"c{at}") for at, c in enumerate(other)]
    )
    cell = F.when(first, _cell(*mine, *other, F.lit(0))).otherwise(_cell(*other, *mine, F.lit(1)))
    return placed.withColumn("cell", cell).drop("part", "band", "k", "part2", "band2", "k2", "i", "j")


def _pivot_cells(members: DataFrame, turn: int) -> DataFrame | None:
    """The open sets of families with more than a block of them, in blocks, each with the pivots of its family."""
    left = members.where(F.col("part") == OPEN).drop("part")
    large = _sizes(left, "root").where(F.col("_sets") > BLOCK_SETS)
    large = stored(large.select("root", _blocks().alias("k")), "large")
    if large.isEmpty():
        return None
    left = left.join(large, "root")
    # No more than the first of each family leave a task.
    by_hash = Window.partitionBy("root").orderBy(F.xxhash64("cls", F.lit(turn)), "cls")
    pivots = left.withColumn("_at", F.row_number().over(by_hash)).where(F.col("_at") <= PIVOTS).drop("_at")
    pivots = stored(pivots, "pivots")
    chosen = pivots.select("cls")
    others = left.join(F.broadcast(chosen) if pivots.count() <= BROADCAST_ROWS else chosen, "cls", "left_anti")

    def at(block: Column, side: int) -> Column:
        return _cell(*[F.lit(0)] * 5, block + 1, F.lit(side))

    own = others.withColumn("cell", at(F.pmod(F.xxhash64("cls"), F.col("k")).cast("int"), 1))
    spread = pivots.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    spread = spread.withColumn("cell", at(F.col("_block"), 0)).drop("_block")
    return own.unionByName(spread.select(*own.columns)).drop("k")


def _connected_first(
    read: DataFrame, members: DataFrame, size: int, order: GlobalOrder, shared: int, of: int
) -> tuple[DataFrame, DataFrame | None]:
    """``members`` with the part each belongs to, and the links with pivots that have shown it."""
    near = None
    for turn in range(PIVOT_ROUNDS):
        cells = _pivot_cells(members, turn)
        if cells is None:
            break
        found = stored(_links(read, cells, size, order, shared, of).select("cls", "root"), "near")
        near = found if near is None else near.unionByName(found)
        known = components(near.select(F.col("cls").alias("a"), F.col("root").alias("b")))
        parts = known.groupBy("root").agg(F.count(F.lit(1)).alias("_sets")).where(F.col("_sets") > BLOCK_SETS)
        known = known.join(parts.select("root"), "root", "left_semi")
        members = stored(
            members.drop("part").join(known.select(F.col("id").alias("cls"), F.col("root").alias("part")), "cls", "left")
            .withColumn("part", F.coalesce("part", F.lit(OPEN))),
            "parts",
        )
    return members, near


def _walk(
    tree: list[np.ndarray], tree_sizes: np.ndarray, probes: list[np.ndarray], probe_sizes: np.ndarray, shared: int, of: int
) -> Iterator[tuple[int, np.ndarray]]:
    """For each set of ``tree`` the probes that link with it. Members are numbers in the order of the tree."""
    width = max((int(x[-1]) for x in (*tree, *probes) if len(x)), default=-1) + 1
    held = np.zeros((width, len(probes)), np.uint8)
    for k, probe in enumerate(probes):
        held[probe, k] = 1
    lengths = np.array([len(p) for p in probes], np.int64)
    # In the order of their bytes, sets that share a way from the root stand together.
    by_path = sorted(range(len(tree)), key=lambda i: tree[i].astype(">u4").tobytes())
    paths = [tree[i] for i in by_path]
    common = [0] * (len(paths) + 1)
    for i in range(1, len(paths)):
        n = min(len(paths[i - 1]), len(paths[i]))
        differ = np.flatnonzero(paths[i - 1][:n] != paths[i][:n])
        common[i] = int(differ[0]) if len(differ) else n
    way_lengths = np.array([len(p) for p in paths], np.int64)
    sizes = tree_sizes[by_path]

    def hopeful(overlap, active, depth, first, last):
        """Probes that some set of the subtree may still link with."""
        rest = way_lengths[first:last].max() - depth
        most = overlap + np.minimum(rest, lengths[active] - overlap)
        return most * (of + shared) >= shared * (sizes[first:last].min() + probe_sizes[active])

    stack = [(0, np.zeros(len(probes), np.int64), np.arange(len(probes)))]
    for i, path in enumerate(paths):
        while stack[-1][0] > common[i]:
            stack.pop()
        depth, overlap, active = stack[-1]
        branch = common[i + 1]
        if branch > depth:
            last = i + 1
            while last < len(paths) and common[last] >= branch:
                last += 1
            overlap = overlap + held[path[depth:branch]][:, active].sum(axis=0, dtype=np.int64)
            stay = hopeful(overlap, active, branch, i, last)
            depth, overlap, active = branch, overlap[stay], active[stay]
            stack.append((depth, overlap, active))
        stay = hopeful(overlap, active, depth, i, i + 1)
        overlap, active = overlap[stay], active[stay]
        if len(active):
            overlap = overlap + held[path[depth:]][:, active].sum(axis=0, dtype=np.int64)
            linked = overlap * (of + shared) >= shared * (sizes[i] + probe_sizes[active])
            yield by_path[i], active[linked]


def join_cell(
    ids: np.ndarray, copies: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], within: bool, order: GlobalOrder,
    shared: int, of: int,
) -> tuple[np.ndarray, np.ndarray]:
    """Per set the number of documents it links with, and the smallest id it is connected to by links of this cell.

    ``within``: all pairs count, else those of the two sides. ``copies``: how many documents a set stands for.
    """
    whole, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    # Only members of two sets, with two sides of both, can be shared; the others count in the sizes alone.
    if within:
        useful = np.bincount(inverse, minlength=len(whole)) > 1
    else:
        useful = np.ones(len(whole), bool)
        for side in (0, 1):
            useful &= np.bincount(inverse[sides[owner] == side], minlength=len(whole)) > 0
    rank = np.full(len(whole), -1)
    kept = order.sorted(whole[useful])[::-1]  # the most frequent first
    rank[np.searchsorted(whole, kept)] = np.arange(len(kept))
    numbered = rank[inverse]
    ways = [np.sort(x[x >= 0]) for x in np.split(numbered, np.cumsum([len(s) for s in sets])[:-1])]
    sizes = np.array([len(s) for s in sets], np.int64)
    linked = np.zeros(len(sets), np.int64)
    label = np.arange(len(sets))
    rows = np.arange(len(sets))
    tree, probes = (rows, rows) if within else (rows[sides == 0], rows[sides == 1])
    if len(tree) and len(probes):
        walk = _walk([ways[i] for i in tree], sizes[tree], [ways[i] for i in probes], sizes[probes], shared, of)
        for k, found in walk:
            one, others = tree[k], probes[found]
            others = others[ids[others] != ids[one]]
            if not len(others):
                continue
            linked[one] += copies[others].sum()
            if not within:
                linked[others] += copies[one]
            joined = np.unique(label[np.append(others, one)])
            if len(joined) > 1:
                label[np.isin(label, joined)] = joined[0]
    roots = np.full(len(sets), np.iinfo(np.int64).max)
    np.minimum.at(roots, label, ids)
    return linked, roots[label]


def _links(read: DataFrame, cells: DataFrame, size: int, order: GlobalOrder, shared: int, of: int) -> DataFrame:
    """``(cls, links, root)`` of each class in each cell where it has links. ``cells (cls, n, c1, c2, copies, root, cell)``."""
    cells = stored(cells, "cells")
    wanted = cells.select(F.col("cls").alias("doc_id")).distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted.hint("shuffle_hash")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            found = [shingle_set(t, size) for t in batch.column("text").to_pylist()]
            signed = [_signature(x) for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([s[0] for s in signed], pa.int64()),
                    pa.array([s[1] for s in signed], pa.int64()),
                    pa.array([x.tobytes() for x in found], pa.binary()),
                ],
                names=["cls", "c1", "c2", "grams"],
            )

    sets = for_python(read).join(wanted, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(
        fetch, "cls long, c1 long, c2 long, grams binary"
    )
    few = cells.count() <= BROADCAST_ROWS
    placed = sets.join(F.broadcast(cells) if few else cells, ["cls", "c1", "c2"]).select(
        "root", "cell.*", "cls", "copies", "grams"
    )

    def join(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        ids = group.column("cls").to_numpy()
        _, first = np.unique(ids, return_index=True)  # rows that repeat a document bring its set twice
        sides = group.column("side").to_numpy()[first]
        grams = [np.frombuffer(g.as_py(), np.uint64) for g in group.column("grams").take(pa.array(first))]
        low, high = [x.as_py() for x in key[1:4]], [x.as_py() for x in key[4:7]]
        linked, roots = join_cell(
            ids[first], group.column("copies").to_numpy()[first], sides, grams, low == high, order, shared, of
        )
        some = linked > 0
        return pa.table({"cls": ids[first][some], "links": linked[some], "root": roots[some]})

    return placed.groupBy("root", "low_band", "low_part", "low", "high_band", "high_part", "high").applyInArrow(
        join, "cls long, links long, root long"
    )


def linked_documents(
    docs: DataFrame, size: int = SHINGLE, shared: int = SHARED, of: int = OF, id_col: str = "doc_id", text_col: str = "text",
    count_links: bool = True,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links, _key`` of every row; ``n_links`` only where ``count_links`` asks for it.

    Two documents link when ``of`` times their shared n-grams are at least ``shared`` times all of theirs.
    ``component_id`` is the smallest doc_id reachable by links, itself included; ``n_links`` the number of documents
    linked with this one, copies included. Null and empty texts have no n-grams and link with nothing. Rows without a
    doc_id are not linked and have no component. Each row is a document, rows that repeat a doc_id and text are
    copies; classes of the same smallest doc_id count as one. ``_key`` is a hash of the text. Other columns are not read.
    Counting links compares all pairs of a family that sizes allow; the components alone take a large family of near
    copies in time that grows with its size.
    """
    if not 0 < shared <= of:
        raise ValueError("the similarity must lie above 0 and not above 1")
    spark = docs.sparkSession
    text = F.col(text_col)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("_key"), text.alias("text"))
    order = GlobalOrder(_counts(read, size))
    sets = stored(_sets(read, size, order, shared, of), "sets")
    usable = sets.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    same = ["n", "c1", "c2"]
    classes = stored(
        usable.groupBy(*same).agg(
            F.min("doc_id").alias("cls"), F.count(F.lit(1)).alias("copies"), F.min_by("first", "doc_id").alias("first")
        ),
        "classes",
    )
    families = components(_candidates(classes, shared, of))
    members = stored(
        classes.select("cls", *same, "copies").join(families.select(F.col("id").alias("cls"), "root"), "cls"), "members"
    )
    members, near = members.withColumn("part", F.lit(OPEN).cast("long")), None
    if not count_links:
        members, near = _connected_first(read, members, size, order, shared, of)
    links = stored(_links(read, _cells(members, shared, of), size, order, shared, of), "links")
    ends = links.select("cls", "root") if near is None else links.select("cls", "root").unionByName(near)
    parts = components(ends.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("cls").agg(F.sum("links").alias("links"))
    known = (
        classes.select(*same, "cls", "copies")
        .join(parts.select(F.col("id").alias("cls"), F.col("root").alias("component")), "cls", "left")
        .join(counts, "cls", "left")
        .select(
            *same, F.coalesce("component", "cls").alias("component"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
        )
    )
    there = F.col("n_shingles") > 0
    counted = F.when(there & F.col("doc_id").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(F.lit(0))
    return (
        sets.select("doc_id", "_key", *same).join(known, same, "left")
        .withColumnRenamed("n", "n_shingles")
        .select(
            "doc_id", "n_shingles",
            F.when(F.col("doc_id").isNull(), F.lit(None).cast("long"))
            .when(there, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
            *([counted.cast("long").alias("n_links")] if count_links else []),
            "_key",
        )
    )


def one_of_each(docs: DataFrame, size: int = SHINGLE, shared: int = SHARED, of: int = OF) -> DataFrame:
    """The rows of ``docs``, all columns, one of each group of linked documents: that of the smallest doc_id.

    Of rows that repeat a doc_id and its text one stays. Rows without a doc_id stay.
    """
    found = stored(
        linked_documents(docs, size, shared, of, count_links=False).select("doc_id", "_key", "component_id"), "linked"
    )
    gone = found.where(F.col("component_id") != F.col("doc_id")).select(
        F.col("doc_id").alias("_gone_id"), F.col("_key").alias("_gone_key")
    ).distinct()
    gone = stored(gone, "gone")
    few = gone.count() <= BROADCAST_ROWS
    same = (docs["doc_id"].cast("long") == F.col("_gone_id")) & (F.xxhash64(docs["text"]) == F.col("_gone_key"))
    kept = docs.join(F.broadcast(gone) if few else gone.hint("shuffle_hash"), same, "left_anti")
    twice = found.where("doc_id is not null").groupBy("doc_id", "_key").count().where("count > 1")
    if twice.isEmpty():
        return kept
    once = kept.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "text"])
    return kept.where(F.col("doc_id").isNull()).unionByName(once)
