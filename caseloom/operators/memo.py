"""Embeddings kept from one search to the next, and models that are loaded once per worker."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.functions.text import non_blank
from caseloom.operators.joins import hot_keys, salted_join
from caseloom.session import written
from caseloom.sources.sinks import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

Embed = Callable[[DataFrame, str], DataFrame]
#: Takes texts, gives a vector or None for each.
Encode = Callable[[Sequence[str]], Sequence[Sequence[float] | None]]

SCHEMA = "text_key string, model string, embedding array<float>"


class EmbeddingMemo:
    """An embedder that asks ``embed`` for each distinct text once and keeps the vector, by the text's SHA-256 and the name
    of the model, in a table under ``path``.

    It stands wherever an embedder does: ``similar_to(texts, candidates, EmbeddingMemo(spark, path, "model", embed))``.
    Several may share a table; what two of them embed at the same time is stored twice and used once. Texts that the model
    has no vector for are remembered as such. Blank texts get a null and are never asked.
    """

    def __init__(self, spark: SparkSession, path: str, model: str, embed: Embed):
        self.spark, self.path, self.model, self.embed = spark, path, model, embed

    def rows(self) -> DataFrame:
        """``text_key, embedding`` of the texts that this model has read."""
        schema = T.StructType.fromDDL(SCHEMA)
        held = stored(self.spark, self.path, schema)
        if held is None:
            held = self.spark.createDataFrame([], schema)
        return held.where(F.col("model") == self.model).select("text_key", "embedding")

    def __call__(self, docs: DataFrame, text: str) -> DataFrame:
        """The documents with ``embedding``; new texts are embedded and stored while this is called."""
        said = F.when(non_blank(F.col(text)), F.sha2(F.col(text), 256))
        keyed = written(docs.withColumns({"text_key": said, "_row": F.expr("uuid()")}), "asked")
        distinct = (
            keyed.where(F.col("text_key").isNotNull()).groupBy("text_key").agg(F.any_value(text).alias("_text"))
        )
        fresh = self.embed(distinct.join(self.rows(), "text_key", "left_anti"), "_text")
        fresh.select(
            "text_key", F.lit(self.model).alias("model"), F.col("embedding").cast("array<float>").alias("embedding")
        ).write.mode("append").parquet(self.path)
        known = self.rows().join(distinct.select("text_key"), "text_key", "left_semi").dropDuplicates(["text_key"])
        asked = keyed.where(F.col("text_key").isNotNull())
        found = salted_join(asked, known, "text_key", F.col("_row"), hot=hot_keys(asked.select("text_key"), "text_key"))
        blank = keyed.where(F.col("text_key").isNull()).withColumn("embedding", F.lit(None).cast("array<float>"))
        return found.unionByName(blank).select(*docs.columns, "embedding")


def by_model(name: str, load: Callable[[], Encode], rows: int = 256) -> Embed:
    """An embedder around a model of one's own.

    ``load`` brings the model to a worker; it is called once in each, however many tasks the worker runs, and what
    it returns gets up to ``rows`` texts that are not blank at a time. ``name`` tells models apart.
    """

    def embed(docs: DataFrame, text: str) -> DataFrame:
        schema = T.StructType([*docs.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encode = _loaded(name, load)
            for batch in batches:
                texts = batch.column(text).to_pylist()
                asked = [i for i, t in enumerate(texts) if t and not t.isspace()]
                vectors: list = [None] * len(texts)
                for begin in range(0, len(asked), rows):
                    part = asked[begin:begin + rows]
                    for i, vector in zip(part, encode([texts[i] for i in part])):
                        vectors[i] = vector
                column = pa.array(vectors, pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "embedding"])

        return docs.mapInArrow(run, schema)

    return embed


def _loaded(name: str, load: Callable[[], Encode]) -> Encode:
    # A module of the worker's own outlives the tasks; the functions of this one come anew with each of them.
    kept = sys.modules.setdefault("_caseloom_models", types.ModuleType("_caseloom_models"))
    if not hasattr(kept, name):
        setattr(kept, name, load())
    return getattr(kept, name)
