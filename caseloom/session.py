"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "caseloom", **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; ``conf`` adds or overrides."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    builder = SparkSession.builder.appName(app)
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@cache
def _scratch() -> tempfile.TemporaryDirectory:
    return tempfile.TemporaryDirectory(prefix="caseloom-", ignore_cleanup_errors=True)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    A local master that names none gets one on this machine that goes when the program ends; any other master
    must name one.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = _scratch().name
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for one run of a job."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the shared folder and read from there by the columns that are asked for.

    Cuts the lineage: neither a second use nor the loss of an executor repeats the steps before.
    """
    spark = rows.sparkSession
    path = run_dir(spark, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def spread(scan: DataFrame, key: str) -> DataFrame:
    """A scan whose rows are dealt out by a unique key where it has fewer partitions than there are cores.

    For dear work on few or large files. ``scan`` reads files and has no join or aggregation in it, so that its
    partitions are known without running anything; large tables have more of them than cores and are left alone.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, key) if scan.rdd.getNumPartitions() < cores else scan
