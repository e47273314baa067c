"""Documents in shards of near equal size: a minimax partition of ordered groups of equal texts.

Groups of equal texts stay whole. In the order of their smallest doc_id they are cut into consecutive shards
such that the largest shard is as small as any such cut allows. The smallest capacity is found by binary search;
each capacity is tried greedily. The driver never holds the sizes: it knows the first and last group end in
each of a bounded number of intervals and asks for a finer split of those few intervals where a cut may fall.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import running_total, small_frame, stored

N_SHARDS = 16
#: Intervals of the first look, and into how many each interval in doubt is split.
FIRST_INTERVALS = 1 << 16
FINER_INTERVALS = 1 << 10


class _Ends:
    """The running totals at which groups end, known by intervals, made finer where asked."""

    def __init__(self, ends: DataFrame, total: int):
        self.total = total
        self.width = max(1, -(-total // FIRST_INTERVALS))
        self.ends = ends.select("end", F.floor(F.col("end") / F.lit(self.width)).alias("first"))
        rows = (
            self.ends.groupBy("first")
            .agg(F.min("end").alias("lo"), F.max("end").alias("hi"), F.count(F.lit(1)).alias("n"))
            .collect()
        )
        self._keep([(r["lo"], r["hi"], r["n"]) for r in rows])

    def _keep(self, found: list[tuple[int, int, int]]) -> None:
        self.found = sorted(found)
        self.starts = [lo for lo, _, _ in self.found]

    def last_until(self, x: int) -> tuple[int, int, int | None]:
        """The largest end up to ``x``: a lower and an upper bound, and the interval to ask for if they differ."""
        at = bisect_right(self.starts, x) - 1
        if at < 0:
            return 0, 0, None
        lo, hi, n = self.found[at]
        if x >= hi:
            return hi, hi, None
        if n <= 2:
            return lo, lo, None
        return lo, x, at

    def finer(self, places: set[int]) -> None:
        spark = self.ends.sparkSession
        asked = [(p, *self.found[p][:2], self.found[p][0] // self.width) for p in places]
        # An interval never crosses a first one, so each end meets only the asked intervals of its own.
        wanted = small_frame(spark, asked, "place long, lo long, hi long, first long")
        step = F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo") + 1) / F.lit(FINER_INTERVALS)))
        rows = (
            self.ends.join(F.broadcast(wanted), "first")
            .where((F.col("end") >= F.col("lo")) & (F.col("end") <= F.col("hi")))
            .groupBy("place", F.floor((F.col("end") - F.col("lo")) / step).alias("part"))
            .agg(F.min("end").alias("lo"), F.max("end").alias("hi"), F.count(F.lit(1)).alias("n"))
            .collect()
        )
        rest = [x for i, x in enumerate(self.found) if i not in places]
        self._keep(rest + [(r["lo"], r["hi"], r["n"]) for r in rows])


def _fits(ends: _Ends, capacity: int, start: int, shards: int, hopeful: bool, doubts: set[int]) -> bool:
    """Whether greedy filling from ``start`` needs at most ``shards``; ends in doubt are taken low or high."""
    at = start
    for _ in range(shards):
        if at + capacity >= ends.total:
            return True
        low, high, place = ends.last_until(at + capacity)
        if place is not None:
            doubts.add(place)
        reached = high if hopeful else low
        if reached <= at:
            return False
        at = reached
    return at >= ends.total


def _surely_fits(ends: _Ends, capacity: int, start: int, shards: int) -> bool:
    while True:
        doubts: set[int] = set()
        if _fits(ends, capacity, start, shards, False, doubts):
            return True
        if not _fits(ends, capacity, start, shards, True, doubts):
            return False
        ends.finer(doubts)


def _last_until(ends: _Ends, x: int) -> int:
    while True:
        low, high, place = ends.last_until(x)
        if place is None:
            return low
        ends.finer({place})


def minimax_cuts(ends: DataFrame, total: int, largest: int, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity and the running totals at which the shards but the last end.

    ``ends (end long)``: the running total at the end of each group, in order. Within the capacity each shard
    aims at its part of what is left, so that a giant group leaves no shards empty that need not be.
    """
    if total <= 0:
        return 0, [0] * (shards - 1)
    known = _Ends(ends, total)
    low, high = max(largest, -(-total // shards)), -(-total // shards) + largest
    while low < high:
        middle = (low + high) // 2
        if _surely_fits(known, middle, 0, shards):
            high = middle
        else:
            low = middle + 1
    cuts, at = [], 0
    for k in range(shards - 1):
        left = shards - k
        aim = _last_until(known, min(total, at + -(-(total - at) // left)))
        if aim <= at or not _surely_fits(known, low, aim, left - 1):
            aim = _last_until(known, min(total, at + low))
        cuts.append(aim)
        at = aim
    return low, cuts


def shards(docs: DataFrame, n_shards: int = N_SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    ``size`` is the text's UTF-8 bytes plus 1. Null texts count as no bytes and form a group of their own, apart
    from empty ones. Rows without a doc_id come last in the order. Repeated rows each get a slot. An empty table
    gives an empty result. Other columns are not read.
    """
    text = F.col(text_col)
    base = stored(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.unhex(F.md5(text.cast("binary"))), F.lit(b"\0")).alias("_same"),
        ),
        "sizes",
    )
    groups = base.groupBy("_same").agg(F.min("doc_id").alias("_first"), F.sum("size").alias("_bytes"))
    ordered = stored(
        running_total(groups, [F.col("_first").asc_nulls_last(), F.col("_same")], "_bytes", "_before"), "groups"
    )
    known = ordered.agg(F.sum("_bytes").alias("total"), F.max("_bytes").alias("largest")).first()
    ends = ordered.select((F.col("_before") + F.col("_bytes")).alias("end"))
    _, cuts = minimax_cuts(ends, known["total"] or 0, known["largest"] or 0, n_shards)
    shard = sum((F.when(F.col("_before") >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    placed = base.join(ordered.select("_same", "_first", shard.cast("int").alias("shard")), "_same").withColumn(
        "_one", F.lit(1).cast("long")
    )
    order: list[Column] = [
        F.col("shard"), F.col("_first").asc_nulls_last(), F.col("_same"), F.col("doc_id").asc_nulls_last()
    ]
    counted = running_total(placed, order, "_one", "_place")
    starts, before = [], 0
    for row in counted.groupBy("shard").count().orderBy("shard").collect():
        starts.append((row["shard"], before))
        before += row["count"]
    starts = small_frame(docs.sparkSession, starts, "shard int, _start long")
    return counted.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_place") - F.col("_start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
