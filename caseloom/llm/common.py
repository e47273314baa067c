"""What several corpus operators share: words, stored steps, running totals, components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.session import run_dir

#: White space of the word rules: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"
#: Texts of an Arrow batch that a Python worker holds as strings at a time.
TEXTS_AT_ONCE = 500
#: Bytes after which an Arrow batch of texts ends, where the session does not set it. Rows count too, as Spark has it.
BATCH_BYTES = 2 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read from there.

    Cuts the lineage: a lost executor costs the tasks that ran on it, never the steps before.
    """
    spark = df.sparkSession
    path = run_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def for_python(texts: DataFrame) -> DataFrame:
    """The same rows, that go to Python in Arrow batches of about ``BATCH_BYTES``.

    By their number alone all texts of a task are one batch, which the executor holds in several buffers outside its heap and
    the worker once more. The limit is one of the session and stays, as rows are read when the result is; one already set holds.
    """
    spark = texts.sparkSession
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    return texts


def text_lists(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts of a batch as strings, ``TEXTS_AT_ONCE`` at a time."""
    for start in range(0, len(texts), TEXTS_AT_ONCE):
        yield texts.slice(start, TEXTS_AT_ONCE).to_pylist()


def small_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few rows that the driver made, read in one task."""
    return spark.createDataFrame(rows, schema).coalesce(1)


def first_hashes(hashed: Column, wanted: int, total: int, spare: int = 4) -> Column:
    """Of ``total`` rows with evenly spread hashes, those with the smallest, about ``spare`` times ``wanted``.

    Asked before ``orderBy(hash).limit(wanted)``, so that what the tasks keep for it does not grow with their number.
    """
    if total <= spare * wanted:
        return F.lit(True)
    return hashed <= F.lit(int((1 << 64) * (spare * wanted / total)) - (1 << 63))


def running_total(df: DataFrame, order: list[Column], weight: str, out: str) -> DataFrame:
    """Adds ``out``: the total ``weight`` of all rows before this one in ``order``.

    Rows are dealt by ranges of the order, summed where they are, and moved on by the totals of the
    ranges before: the driver sees one number per range. ``order`` must tell all rows apart, or the
    rows it does not tell apart come in any sequence.
    """
    spark = df.sparkSession
    schema = T.StructType([
        *df.schema.fields,
        T.StructField("_range", T.IntegerType()),
        T.StructField("_inside", T.LongType()),
    ])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        place, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            weights = batch.column(weight).to_numpy(zero_copy_only=False).astype("int64")
            ends = np.cumsum(weights) + total
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(np.full(len(weights), place, "int32")),
                    pa.array(ends - weights),
                ],
                names=[*batch.schema.names, "_range", "_inside"],
            )
            total = int(ends[-1]) if len(ends) else total

    placed = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(add, schema), "ranges")
    sums = placed.groupBy("_range").agg(F.sum(weight).alias("n")).orderBy("_range").collect()
    before, starts = 0, []
    for row in sums:
        starts.append((row["_range"], before))
        before += row["n"]
    starts = small_frame(spark, starts, "_range int, _start long")
    return (
        placed.join(F.broadcast(starts), "_range")
        .withColumn(out, F.col("_inside") + F.col("_start"))
        .drop("_range", "_inside", "_start")
    )


def components(edges: DataFrame, steps: int = 60) -> DataFrame:
    """Connected components of ``edges (a long, b long)``: ``(id, root)``, root the smallest id reached.

    Two steps in turn until nothing changes: every node sends its larger neighbours to the smallest node it knows,
    then every node sends itself and its smaller neighbours there. What is left are stars around the smallest
    ids. All steps are joins and grouped minima over stored tables. Links of a node to itself and null ends are
    ignored; a node without a link to another has no row.
    """
    links = stored(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    seen = _fingerprint(links)
    for _ in range(steps):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        links = links.join(least, "b").select("a", F.least("b", "m").alias("b")).distinct()
        links = stored(links, "links")
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        links = links.join(least, "a").select(
            F.explode(F.array(
                F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))
            )).alias("x")
        ).select("x.*").where(F.col("a") != F.col("b")).distinct()
        links = stored(links, "links")
        now = _fingerprint(links)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components: links still change after the last step")
    roots = links.select("b").distinct().select(F.col("b").alias("id"), F.col("b").alias("root"))
    return links.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(roots)


def _fingerprint(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
