"""Joins that stay even when a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.text import non_blank
from caseloom.functions.vectors import hash_embed

SALTS = 16
#: Rows from which on a key is spread over several tasks.
HOT_ROWS = 10_000


def salted_join(
    many: DataFrame, one: DataFrame, key: str, spread: Column, salts: int = SALTS, hot: DataFrame | None = None
) -> DataFrame:
    """Inner join of a table with repeated keys to a table that has few rows per key.

    The rows of a key are spread over ``salts`` tasks by ``spread``, a column of ``many`` that
    differs between them; the other side is repeated once per salt. ``hot``, a few keys, has this done for
    these only: for wide rows, as all others then cross the shuffle once.
    """
    salt = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    if hot is None:
        salted, repeated = many.withColumn("_salt", salt), one.withColumn("_salt", F.explode(every))
    else:
        marked = F.broadcast(hot.select(key, F.lit(True).alias("_hot")))
        salted = many.join(marked, key, "left").withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(0))
        salts_of = F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0)))
        repeated = one.join(marked, key, "left").withColumn("_salt", F.explode(salts_of)).drop("_hot")
        salted = salted.drop("_hot")
    return salted.join(repeated, [key, "_salt"]).drop("_salt")


def hot_keys(many: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """The keys with more than ``rows`` rows (``HOT_ROWS``); there can be no more than the rows of the table by this number."""
    return many.groupBy(key).count().where(F.col("count") > (HOT_ROWS if rows is None else rows)).select(key)


def attach_embeddings(tickets: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Inner join of tickets and their vectors on ``id``; tickets without a vector drop.

    Both sides have unique ids, so no key can be hot. Tables bucketed by id join without a shuffle.
    """
    return tickets.join(embeddings.select("id", "embedding"), "id")


def embed_once(
    docs: DataFrame,
    key: str,
    text: str,
    embed: Callable[[DataFrame, str], DataFrame] = hash_embed,
    max_chars: int | None = None,
) -> DataFrame:
    """Add ``embedding`` to documents, embedding every distinct text only once.

    ``embed`` takes a table and the name of its text column and adds ``embedding``; a model is
    plugged in here. ``max_chars`` cuts the text for models that have such a limit. The text itself
    is shuffled once, to find the distinct ones; the join back goes by its SHA-256. Blank texts drop.
    Texts the model gives no vector for keep a null: a filter here would run the model once more.
    """
    said = F.col(text) if max_chars is None else F.substring(text, 1, max_chars)
    keyed = docs.withColumn("text_key", F.sha2(said, 256))
    distinct = (
        keyed.where(non_blank(F.col(text)))
        .groupBy("text_key")
        .agg(F.any_value(said).alias("_text"), F.count(F.lit(1)).alias("copies"))
    )
    embedded = embed(distinct, "_text").drop("_text")
    # Vectors are wide: only those of texts with very many copies are repeated.
    return salted_join(keyed, embedded, "text_key", F.col(key), hot=hot_keys(keyed.select("text_key"), "text_key"))
