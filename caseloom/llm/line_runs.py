"""Lines repeated across documents, found by levelled sorted runs of line hashes.

Batches of documents are added one after another. Each batch is anti-joined by merge with the runs of all earlier
ones; the line hashes no run holds become the batch's own sorted run, the others are counted for the hashes
already held. When a level holds ``fanout`` runs they are merged into one run of the next level, so the number of
runs grows with the logarithm of the number of batches. All of it is joins and sums over narrow tables.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.common import WHITE, stored
from caseloom.session import run_dir

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
FANOUT = 2
HASH = ["h1", "h2"]


class LineRuns:
    """Runs of ``(h1, h2, n_docs, last_doc)`` under one folder; ``add`` batches, then ask for ``repeated`` lines."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        if fanout < 2:
            raise ValueError("fanout must be at least 2")
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[DataFrame]] = []
        self.again: list[DataFrame] = []

    def _sorted(self, rows: DataFrame) -> DataFrame:
        return stored(rows.repartitionByRange(*HASH).sortWithinPartitions(*HASH), "run")

    def _runs(self) -> DataFrame | None:
        return _union(run for level in self.levels for run in level)

    def add(self, lines: DataFrame) -> None:
        """Add a batch ``(doc_id, h1, h2)``. All lines of a document must come in the same batch."""
        keys = stored(
            lines.select("doc_id", *HASH).distinct().groupBy(*HASH)
            .agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc")),
            "batch",
        )
        held = self._runs()
        if held is not None:
            held = held.select(*HASH).hint("merge")
            self.again.append(stored(keys.join(held, HASH, "left_semi"), "again"))
            keys = keys.join(held, HASH, "left_anti")
        self._place(self._sorted(keys), 0)

    def _place(self, run: DataFrame, level: int) -> None:
        if len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = _union(self.levels[level]), []
            self._place(self._sorted(merged), level + 1)

    def repeated(self, min_docs: int) -> DataFrame:
        """``(h1, h2, n_docs, last_doc)`` of the hashes found in at least ``min_docs`` documents."""
        held = _union([x for x in (self._runs(), *self.again) if x is not None])
        return (
            held.groupBy(*HASH)
            .agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))
            .where(F.col("n_docs") >= min_docs)
        )


def _union(frames: Iterable[DataFrame]) -> DataFrame | None:
    whole = None
    for frame in frames:
        whole = frame if whole is None else whole.unionByName(frame)
    return whole


def lines_of(text: Column) -> Column:
    """The lines of a text; null and empty texts are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """What makes lines equal: white space stripped at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(WHITE)), string.ascii_uppercase, string.ascii_lowercase)


def without_repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    batches: int = BATCHES,
    batch_of: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text`` of every row, repeated lines left out.

    Lines whose key has at least ``min_chars`` code points and stands in at least ``min_docs`` documents stay only
    in the largest doc_id that holds it, there in all places. Rows that repeat a doc_id count as one
    document; rows without a doc_id hold no line for others and keep all of theirs. A text that loses all lines is
    empty. The documents are dealt into ``batches`` by ``batch_of`` their id. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn(
        "_row", F.xxhash64("text")
    )
    key = line_key(F.col("line"))
    lines = (
        rows.where(F.col("doc_id").isNotNull())
        .select("doc_id", "_row", F.posexplode(lines_of(F.col("text"))).alias("place", "line"))
        .select("doc_id", "_row", "place", key.alias("key"))
        .where(F.length("key") >= min_chars)
        .select(
            "doc_id", "_row", "place",
            F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2"),
            F.pmod(batch_of(F.col("doc_id")), F.lit(batches)).cast("int").alias("batch"),
        )
    )
    lines = stored(lines, "lines")
    runs = LineRuns(docs.sparkSession)
    for batch in range(batches):
        runs.add(lines.where(F.col("batch") == batch))
    dropped = (
        lines.select("doc_id", "_row", "place", *HASH)
        .join(runs.repeated(min_docs), HASH)
        .where(F.col("doc_id") != F.col("last_doc"))
        .groupBy("doc_id", "_row")
        .agg(F.collect_set("place").alias("_out"))
    )
    split = lines_of(F.col("text"))
    last = F.size("_lines") - 1
    places = F.array_except(F.sequence(F.lit(0), last), F.col("_out"))
    kept = F.array_join(F.transform(places, lambda i: F.get(F.col("_lines"), i)), "\n")
    return (
        rows.join(dropped.hint("shuffle_hash"), ["doc_id", "_row"], "left")
        .withColumn("_lines", split)
        .select(
            "doc_id",
            F.size("_lines").cast("long").alias("n_lines"),
            F.coalesce(F.size("_out"), F.lit(0)).cast("long").alias("n_dropped"),
            F.when(F.col("_out").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept).alias("text"),
        )
    )
