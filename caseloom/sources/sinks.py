"""Writing tickets, accounts and result tables."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.session import written
from caseloom.sources.readers import REJECTED, good_rows, rejected_rows


cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Buckets of a store laid out by a hash of its keys, and the column that names them.
KEY_BUCKETS = 64
BUCKET = "key_bucket"
#: Up to so many arriving keys are looked up in the Bloom filters of the files.
PROBED_KEYS = 50


def with_new_id(tickets: DataFrame) -> DataFrame:
    """A fresh id per row: loading the same sheet twice stores its rows twice."""
    return tickets.withColumn("id", F.expr("uuid()"))


def with_content_id(tickets: DataFrame) -> DataFrame:
    """An id made of the row's own contents: the same row always gets the same id."""
    content = sorted(c for c in tickets.columns if c not in ("id", "ts"))
    return tickets.withColumn("id", F.sha2(F.to_json(F.struct(*content)), 256))


def one_per_key(rows: DataFrame, key: str, first: list[Column]) -> DataFrame:
    """The first row of each key by ``first``. Rows are merged before they are shuffled."""
    row = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(key).agg(F.min_by(row, F.struct(*first)).alias("_row")).select("_row.*")


def absent_from(new: DataFrame, existing: DataFrame, key: str, first: list[Column]) -> DataFrame:
    """Rows of ``new`` whose key is not in ``existing``, one row per key: the first by ``first``.

    Both sides of the anti join have unique keys, so many copies of one key cost nothing.
    """
    known = existing.select(key).distinct()
    return one_per_key(new, key, first).join(known, key, "left_anti").select(*new.columns)


def stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """The table at a path, if there is one."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def insert_absent(new: DataFrame, path: str, key: str, first: list[Column]) -> int:
    """Append the rows whose key a stored table does not hold, one per key; returns how many."""
    present = stored(new.sparkSession, path, new.schema)
    rows = one_per_key(new, key, first) if present is None else absent_from(new, present, key, first)
    return append(rows.select(*new.columns), path)


def insert_absent_by_bucket(
    new: DataFrame, path: str, key: str, first: list[Column], buckets: int = KEY_BUCKETS
) -> int:
    """Like ``insert_absent``, for a store laid out by a hash of its keys: only the buckets the new keys fall into are read.

    Every file has a Bloom filter of its keys; where no more than ``PROBED_KEYS`` keys arrive, it tells which files
    need not be read at all. The new rows are written down first, as they are asked for three times. ``buckets``
    must be the same for all writes to a store. A null key falls into a bucket like any other and equals no stored one.
    """
    spark = new.sparkSession
    arriving = written(
        one_per_key(new, key, first).select(*new.columns, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias(BUCKET)),
        "arriving",
    )
    touched = [row[BUCKET] for row in arriving.select(BUCKET).distinct().collect()]
    fresh = arriving
    present = stored(spark, path, arriving.schema)
    if present is not None:
        fresh = arriving.join(_held(present, arriving, key, touched), [BUCKET, key], "left_anti")
    seen = Observation("insert")
    fresh = fresh.select(*arriving.columns).observe(seen, F.count(F.lit(1)).alias("written"))
    (
        fresh.repartition(BUCKET).write.mode("append").partitionBy(BUCKET)
        .option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path)
    )
    return int(seen.get["written"])


def _held(present: DataFrame, arriving: DataFrame, key: str, touched: list[int]) -> DataFrame:
    """The stored keys that the arriving ones may meet, from the buckets they fall into."""
    held = present.where(F.col(BUCKET).isin(touched))
    few = [row[key] for row in arriving.select(key).limit(PROBED_KEYS + 1).collect()]
    if few and len(few) <= PROBED_KEYS:
        # Equalities one by one: Spark asks the Bloom filters for these, and only for the range of a longer list.
        held = held.where(reduce(lambda a, b: a | b, [F.col(key) == F.lit(k) for k in few]))
    return held.select(BUCKET, key)


def append_once(tickets: DataFrame, path: str) -> int:
    """Append the tickets a stored table does not hold yet; returns the number of rows written."""
    return insert_absent(with_write_time(with_content_id(tickets)), path, "id", [F.col("ts")])


def append_all(tickets: DataFrame, path: str) -> int:
    """Append all tickets under fresh ids; returns the number of rows written."""
    return append(with_write_time(with_new_id(tickets)), path)


def with_write_time(tickets: DataFrame) -> DataFrame:
    """The time of writing, in epoch seconds, for tickets that bring no time of their own."""
    return tickets.withColumn("ts", F.coalesce("ts", F.unix_timestamp()))


def append(rows: DataFrame, path: str) -> int:
    seen = Observation("append")
    rows.observe(seen, F.count(F.lit(1)).alias("written")).write.mode("append").parquet(path)
    return int(seen.get["written"])


def load_sheet(
    rows: DataFrame, path: str, once: bool = True, rejected_path: str | None = None
) -> dict[str, object]:
    """Store a sheet as ``read_sheet`` gives it; returns its columns and how many rows it had, how many
    of them were rejected as not fitting, and how many were written. The sheet is read once, and once more
    where ``rejected_path`` asks for the rejected rows to be stored, as raw text and what could be read of them."""
    if rejected_path:
        rejected_rows(rows).write.mode("append").parquet(rejected_path)
    seen = Observation("sheet")
    counted = rows.observe(
        seen, F.count(F.lit(1)).alias("read"), F.count_if(F.col(REJECTED).isNotNull()).alias("rejected")
    )
    good = good_rows(counted)
    written = (append_once if once else append_all)(good, path)
    return {"columns": good.columns, **seen.get, "written": written}


def write_bucketed(tickets: DataFrame, table: str, buckets: int) -> None:
    """Store tickets (or their embeddings) as a table bucketed by id: joins on id then need no shuffle."""
    tickets.write.mode("overwrite").bucketBy(buckets, "id").sortBy("id").saveAsTable(table)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text per row, nulls kept as such."""
    return df.select(
        F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias("json")
    )


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_under(lines: DataFrame, heads: list[str], path: str) -> None:
    """Write the lines of a sheet (one text column) as a folder of files, each with the same lines above its own."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(heads)], names=["line"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays(batch.columns, names=["line"])

    lines.mapInArrow(put, "line string").write.text(path)


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """Write the tables of a cluster report, one folder each."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


MANIFEST = "version string, published_at timestamp, tables array<string>"


def publish(tables: dict[str, DataFrame], path: str) -> str:
    """Publish the tables of a report together; returns the name of this version.

    Each version has a folder of its own. Its tables are written there, and the version is entered in the manifest
    when all of them are: readers see the whole of a version or none of it, and the versions before stay.
    """
    if not tables:
        raise ValueError("a report has tables")
    root = path.rstrip("/")
    version = uuid.uuid4().hex
    for name, table in tables.items():
        table.write.parquet(f"{root}/{version}/{name}")
    spark = next(iter(tables.values())).sparkSession
    entered = spark.range(1).select(
        F.lit(version).alias("version"), F.current_timestamp().alias("published_at"),
        F.array(*[F.lit(name) for name in tables]).alias("tables"),
    )
    entered.write.mode("append").parquet(f"{root}/manifest")
    return version


def published(spark: SparkSession, path: str, version: str | None = None) -> dict[str, DataFrame]:
    """The tables of the newest version of a report, or of a given one; none where nothing has been published."""
    root = path.rstrip("/")
    manifest = stored(spark, f"{root}/manifest", T.StructType.fromDDL(MANIFEST))
    if manifest is None:
        return {}
    wanted = manifest if version is None else manifest.where(F.col("version") == version)
    newest = wanted.orderBy(F.desc("published_at"), F.desc("version")).limit(1).collect()
    return {
        name: spark.read.parquet(f"{root}/{row['version']}/{name}") for row in newest for name in row["tables"]
    }
