"""Tickets, messages and accounts made of the sample tables.

A document is a ticket: its first line is the summary, the rest the comments, so no text is lost. The
order of the same number gives its dates, status and priority, and the embedding of that number its vector.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.session import spread
from caseloom.sources.schema import TICKET_SCHEMA

# --- fixed values: opening words put before a message, by the number of its conversation ---
OPENINGS = [
    "/similar ",
    "/recommend ",
    "Can you recommend solutions for ",
    "Are there any similar tickets to ",
    "How to fix ",
    "Find tickets related to ",
    "",
    "/help ",
    "/other ",
    "Same issue",
    "please suggest it, same issue as",
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    # Dates are read without a zone; a fixed zone keeps spans between them free of clock changes.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def stream_of(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The files of a table as a stream, whether the table is one file or a folder of files.

    The pattern matches the one path only. As a plain path, a single file would be refused as the base of partitions.
    """
    path = f"{folder.rstrip('/')}/{name}.parque[t]"
    return spark.readStream.schema(table(spark, folder, name).schema).parquet(path)


def _as_text(moment: str):
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss")


def texts(spark: SparkSession, folder: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    """A table for work on its texts, on all cores even where it is one small file."""
    return spread(table(spark, folder, name), key)


def tickets(spark: SparkSession, folder: str, for_text: bool = False) -> DataFrame:
    """``for_text``: texts are worked on, not only looked at."""
    return _view(spark, folder, for_text).select(*TICKET_SCHEMA.names)


def _view(spark: SparkSession, folder: str, for_text: bool = False, beside: DataFrame | None = None) -> DataFrame:
    """The tickets, with the columns of a table ``beside`` them that has their number in ``doc_id``.

    All meet by that number, so that texts are dealt out once at most.
    """
    documents = texts(spark, folder) if for_text else table(spark, folder, "documents")
    orders = table(spark, folder, "orders")
    shipped = (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.max("l_shipdate").alias("shipped"))
    )
    dated = orders.join(shipped, "o_orderkey", "left")
    text = F.col("text")
    line_end = F.instr(text, "\n")
    resolved = (F.col("o_orderstatus") != "O") & (F.col("shipped") >= F.col("o_orderdate"))
    urgency = F.substring("o_orderpriority", 3, 20)
    joined = documents.join(dated, F.col("doc_id") == F.col("o_orderkey"), "left")
    if beside is not None:
        joined = joined.join(beside, "doc_id", "left")
    return joined.select(
        F.col("doc_id").cast("string").alias("id"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("ts"),
        F.concat(F.lit("INC-"), F.col("doc_id").cast("string")).alias("ticket_number"),
        F.substring_index(text, "\n", 1).alias("summary"),
        F.when(line_end > 0, F.substr(text, line_end + 1)).otherwise("").alias("latest_comments"),
        F.col("source").alias("project"),
        F.concat(F.lit("cat"), (F.col("doc_id") % 7).cast("string")).alias("category"),
        F.col("lang").alias("task_type"),
        F.col("o_orderstatus").alias("status"),
        F.when(urgency == "HIGH", "High").otherwise(urgency).alias("priority"),
        F.concat(F.lit("Severity "), F.substring("o_orderpriority", 1, 1)).alias("severity"),
        F.concat(F.lit("owner"), F.col("o_custkey").cast("string")).alias("ticket_owner"),
        _as_text("o_orderdate").alias("date_submitted"),
        F.when(resolved, _as_text("shipped")).otherwise("").alias("resolution_date"),
        *([] if beside is None else [c for c in beside.columns if c != "doc_id"]),
    )


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), "embedding", "label"
    )


def embedded_tickets(spark: SparkSession, folder: str) -> DataFrame:
    """All tickets, with a null vector where there is none."""
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return _view(spark, folder, beside=vectors).select(*TICKET_SCHEMA.names, "embedding")


def ticket_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector as a query."""
    return embeddings(spark, folder).select(
        F.col("id").alias("query_id"), F.col("embedding").alias("query_vec")
    )


def messages(spark: SparkSession, folder: str) -> DataFrame:
    return opened(table(spark, folder, "conversations"))


def opened(conversations: DataFrame) -> DataFrame:
    """Conversation turns with an opening that asks for something."""
    openings = F.array(*[F.lit(o) for o in OPENINGS])
    number = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(OPENINGS))) + 1
    return conversations.select(
        F.concat_ws("-", "conv_id", "turn").alias("message_id"),
        F.concat(F.element_at(openings, number.cast("int")), F.col("text")).alias("text"),
    )


def accounts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Signups (customers and suppliers, some with the same address) and known accounts (event users)."""

    def address(column: str, step: int = 1):
        return F.concat(F.lit("user"), (F.col(column) * step).cast("string"), F.lit("@example.org"))

    signups = table(spark, folder, "customer").select(
        address("c_custkey").alias("email"), F.col("c_name").alias("name")
    ).unionByName(
        table(spark, folder, "supplier").select(
            address("s_suppkey", 13).alias("email"), F.col("s_name").alias("name")
        )
    )
    known = table(spark, folder, "events").select(address("user_id").alias("email"))
    return signups, known
