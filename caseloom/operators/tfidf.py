"""TF-IDF weights of 1- and 2-gram terms as a long table, and the telling terms of groups."""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from caseloom.fixed_values import MAX_DF, MAX_FEATURES, MIN_DF, TOP_KEYWORDS
from caseloom.functions.text import one_two_grams, tokens, without
from caseloom.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOKENS = "_tokens"
ROW = "_row"
#: Tokens of a piece of the documents, about; a document is never cut. There are half as many buckets of terms as pieces.
PIECE_TOKENS = 500_000
#: Tokens counted at a time inside a task, but for a document that has more.
TOKENS_AT_ONCE = 100_000


def tokenised(docs: DataFrame, text: str, stop_words: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The columns to keep, ``_row`` (a number of the document) and the tokens of a text, written down: texts are read once,
    whatever is done with the tokens."""
    found = docs.select(*keep, text).withColumn(TOKENS, without(tokens(F.col(text)), stop_words))
    return written(found.select(*keep, F.monotonically_increasing_id().alias(ROW), TOKENS), "tokens")


def vocabulary(
    docs: DataFrame,
    text: str,
    stop_words: Sequence[str],
    max_features: int | None = MAX_FEATURES,
    min_df: int = MIN_DF,
    max_df: float = MAX_DF,
) -> DataFrame:
    """The terms in use, with their inverse document frequency: ``term, df, total, idf``.

    Terms of at least ``min_df`` documents and at most a share ``max_df`` of them; of those the
    ``max_features`` most frequent, or all.
    """
    return vocabulary_of(tokenised(docs, text, stop_words, []), max_features, min_df, max_df)


def vocabulary_of(split: DataFrame, max_features: int | None, min_df: int, max_df: float) -> DataFrame:
    """The vocabulary of tokenised documents.

    Each document gives each of its terms once, with its count, so both counts come from one aggregation by term, summed
    up in the tasks before the shuffle.
    """
    found = (
        term_counts(split, [])
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
        .withColumn("_n", F.lit(split.count()))
        .where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("_n")))
    )
    if max_features is not None:
        found = found.orderBy(F.desc("total"), "term").limit(max_features)
    idf = F.log((F.lit(1.0) + F.col("_n")) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    return found.withColumn("idf", idf).drop("_n")


def unit_vectors(split: DataFrame, in_use: list[Row], keep: Sequence[str]) -> DataFrame:
    """TF-IDF vectors of unit length, ``features``, of tokenised documents over the terms in use, next to the columns
    to keep.

    Terms are counted and scaled in the row that holds the tokens: nothing is shuffled.
    """
    counter = CountVectorizerModel.from_vocabulary([t["term"] for t in in_use], inputCol="terms", outputCol="tf")
    scale = ElementwiseProduct(
        scalingVec=Vectors.dense([t["idf"] for t in in_use]), inputCol="tf", outputCol="tfidf"
    )
    unit = Normalizer(p=2.0, inputCol="tfidf", outputCol="features")
    described = split.select(*keep, one_two_grams(F.col(TOKENS)).alias("terms"))
    return unit.transform(scale.transform(counter.transform(described))).select(*keep, "features")


def weights(
    docs: DataFrame,
    text: str,
    stop_words: Sequence[str],
    max_features: int | None = MAX_FEATURES,
    min_df: int = MIN_DF,
    max_df: float = MAX_DF,
    keep: Sequence[str] = ("id",),
) -> DataFrame:
    """TF-IDF weights, every document scaled to length one: the columns to keep, ``term, weight``.

    The texts are tokenised and the vocabulary is found while this is called. With ``max_features`` terms are then
    counted in the rows of their tokens and nothing is shuffled. Without, the vocabulary stays in Spark: pieces of the
    documents ask for the frequencies of their terms, each term once a piece. Documents without a term in use have no rows.
    """
    return weights_of(tokenised(docs, text, stop_words, keep), max_features, min_df, max_df, keep)


def weights_of(
    split: DataFrame, max_features: int | None, min_df: int = MIN_DF, max_df: float = MAX_DF, keep: Sequence[str] = ("id",)
) -> DataFrame:
    """The weights of tokenised documents."""
    if max_features is None:
        return _all_weights(split, min_df, max_df, keep)
    found = vocabulary_of(split, max_features, min_df, max_df).select("term", "idf")
    in_use = found.orderBy("term").collect()
    spark = split.sparkSession
    names = spark.createDataFrame([(i, t["term"]) for i, t in enumerate(in_use)], "_at int, term string")
    if not in_use:
        return split.select(*keep).limit(0).withColumns({"term": F.lit(""), "weight": F.lit(0.0)})
    cells = unit_vectors(split, in_use, keep).withColumn("_cells", F.unwrap_udt("features")).select(
        *keep, F.inline(F.arrays_zip(F.col("_cells.indices").alias("_at"), F.col("_cells.values").alias("weight")))
    )
    return cells.join(F.broadcast(names), "_at").select(*keep, "term", "weight")


class _Piece(NamedTuple):
    """The terms of some documents, by bucket and then by their words, and the terms each document has."""

    names: pa.Array
    first: np.ndarray
    second: np.ndarray  # -1 for terms of one word
    bucket: np.ndarray
    df: np.ndarray
    row: np.ndarray
    term: np.ndarray
    tf: np.ndarray

    @classmethod
    def of(cls, lists: pa.ListArray, buckets: int) -> _Piece:
        """The same for the same documents, in whatever order they come."""
        coded = lists.flatten().dictionary_encode()
        by_name = pc.sort_indices(coded.dictionary).to_numpy()
        names, place = coded.dictionary.take(pa.array(by_name)), np.empty(len(by_name), np.int64)
        place[by_name] = np.arange(len(by_name))
        word = place[coded.indices.to_numpy()]
        row = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
        pairs = np.flatnonzero(row[1:] == row[:-1])
        step = len(names) + 1
        code = np.concatenate([word * step, word[pairs] * step + word[pairs + 1] + 1])
        row = np.concatenate([row, row[pairs]])
        order = np.lexsort((code, row))
        code, row = code[order], row[order]
        start = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (row[1:] != row[:-1])))
        tf, code, row = np.diff(np.append(start, len(code))), code[start], row[start]
        terms, term, df = np.unique(code, return_inverse=True, return_counts=True)
        first, second = terms // step, terms % step - 1
        hashes = np.array([zlib.crc32(name.encode()) for name in names.to_pylist()] + [0], np.int64)
        bucket = (hashes[first] * 31 + hashes[second]) % buckets
        dealt = np.argsort(bucket, kind="stable")
        at = np.empty(len(dealt), np.int64)
        at[dealt] = np.arange(len(dealt))
        return cls(names, first[dealt], second[dealt], bucket[dealt], df[dealt], row, at[term], tf)

    def terms(self, chosen: np.ndarray) -> pa.Array:
        one = self.names.take(pa.array(self.first[chosen]))
        second = self.second[chosen]
        other = self.names.take(pa.array(second, mask=second < 0))
        return pc.coalesce(pc.binary_join_element_wise(one, other, " "), one)


def _all_weights(split: DataFrame, min_df: int, max_df: float, keep: Sequence[str]) -> DataFrame:
    """The weights of tokenised documents by all terms that are frequent enough.

    Documents are dealt to pieces by a hash of their number. A piece tells each bucket of terms which of its terms are in how
    many of its documents: one row per piece and bucket, the terms in one text. Where the rows of a bucket meet, the
    documents of each term are added up and go back to the pieces as numbers in the same order; where they meet the
    documents again, these are weighed. Nothing is shuffled by document and term, and the frequent terms are in no more rows
    of a bucket than there are pieces.
    """
    sums = split.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(TOKENS)).alias("tokens")).first()
    n, pieces = sums["n"], 1 + (sums["tokens"] or 0) // PIECE_TOKENS
    buckets = (pieces + 1) // 2
    dealt = split.where(F.size(TOKENS) > 0).select(
        *keep, F.pmod(F.xxhash64(ROW), F.lit(pieces)).alias("_piece"), F.array_join(TOKENS, " ").alias(TOKENS)
    )

    def ask(key: tuple[pa.Scalar, ...], docs: pa.Table) -> pa.Table:
        piece = _Piece.of(_token_lists(docs), buckets)
        start = np.flatnonzero(np.append(True, piece.bucket[1:] != piece.bucket[:-1]))
        ends = pa.array(np.append(start, len(piece.bucket)), pa.int32())
        terms = pa.ListArray.from_arrays(ends, piece.terms(np.arange(len(piece.bucket))))
        return pa.table({
            "_piece": pa.array(np.full(len(start), key[0].as_py()), pa.int64()),
            "bucket": pa.array(piece.bucket[start], pa.int64()),
            "terms": pc.binary_join(terms, "\n"),
            "df": pa.ListArray.from_arrays(ends, pa.array(piece.df, pa.int32())),
        })

    def add(asked: pa.Table) -> pa.Table:
        asked = asked.combine_chunks()
        terms = pc.split_pattern(_whole(asked["terms"]), "\n")
        which = terms.flatten().dictionary_encode().indices.to_numpy()
        found = np.bincount(which, _whole(asked["df"]).flatten().to_numpy())
        found = np.where((found >= min_df) & (found <= max_df * n), found, 0)[which]
        ends = np.append(0, np.cumsum(np.asarray(terms.value_lengths())))
        told = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found.astype(np.int32)))
        return pa.table({"_piece": asked["_piece"], "bucket": asked["bucket"], "df": told})

    def weigh(docs: pa.Table, told: pa.Table) -> pa.Table:
        piece = _Piece.of(_token_lists(docs), buckets)
        df = _whole(told.sort_by("bucket")["df"]).flatten().to_numpy()[piece.term]
        some = np.flatnonzero(df)
        row, term = piece.row[some], piece.term[some]
        weight = piece.tf[some] * (np.log((1.0 + n) / (1.0 + df[some])) + 1.0)
        length = np.sqrt(np.bincount(row, weight * weight, len(docs)))
        found = docs.select(list(keep)).take(pa.array(row))
        return found.append_column("term", piece.terms(term)).append_column("weight", pa.array(weight / length[row]))

    schema = split.select(*keep, F.lit("").alias("term"), F.lit(0.0).alias("weight")).schema
    # Both uses of the pieces ask for the same columns, so that Spark deals the documents once.
    asked = dealt.groupBy("_piece").applyInArrow(
        ask, "_piece long, bucket long, terms string, df array<int>"
    )
    told = asked.groupBy("bucket").applyInArrow(add, "_piece long, bucket long, df array<int>")
    return dealt.groupBy("_piece").cogroup(told.groupBy("_piece")).applyInArrow(weigh, schema)


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _token_lists(docs: pa.Table) -> pa.ListArray:
    return pc.split_pattern(_whole(docs[TOKENS]), " ")


def term_counts(split: DataFrame, keep: Sequence[str]) -> DataFrame:
    """How often each document has each of its terms: the columns to keep, ``_row`` (a number of the document), ``term, tf``.

    Counted in the batch that holds the tokens, ``TOKENS_AT_ONCE`` of them at a time: nothing is shuffled, and a document
    gives each of its terms once.
    """
    rows = split.select(*keep, F.monotonically_increasing_id().alias(ROW), TOKENS)
    kept = [*keep, ROW]
    schema = rows.select(*kept, F.lit("").alias("term"), F.lit(0).cast("long").alias("tf")).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _parts(whole, TOKENS_AT_ONCE)):
            lists = batch.column(TOKENS)
            coded = lists.flatten().dictionary_encode()
            names, word = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(batch)), np.asarray(pc.fill_null(lists.value_lengths(), 0)))
            pairs = np.flatnonzero(row[1:] == row[:-1])
            for words, at in ((word[:, None], row), (np.stack([word[pairs], word[pairs + 1]], axis=1), row[pairs])):
                if len(at) == 0:
                    continue
                code = words[:, 0] * (len(names) if words.shape[1] > 1 else 1) + words[:, -1] * (words.shape[1] > 1)
                order = np.lexsort((code, at))
                code, at, words = code[order], at[order], words[order]
                first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (at[1:] != at[:-1])))
                parts = [names.take(pa.array(column)) for column in words[first].T]
                terms = pc.binary_join_element_wise(*parts, " ")
                tf = np.diff(np.append(first, len(code)))
                columns = batch.select(kept).take(pa.array(at[first])).columns
                yield pa.RecordBatch.from_arrays([*columns, terms, pa.array(tf)], names=[*kept, "term", "tf"])

    return rows.mapInArrow(count, schema)


def _parts(batch: pa.RecordBatch, tokens: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of whole documents with no more than so many tokens, or of one document."""
    ends = np.cumsum(np.asarray(pc.fill_null(batch.column(TOKENS).value_lengths(), 0)))
    begin = 0
    while begin < len(batch):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + tokens, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def group_weights(weighted: DataFrame, key: str) -> DataFrame:
    """Summed weight of every term in every group, ``key, term, weight``, from weights that kept the key."""
    return weighted.groupBy(key, "term").agg(F.sum("weight").alias("weight"))


def keywords(weighted: DataFrame, key: str, n: int = TOP_KEYWORDS) -> DataFrame:
    """The heaviest ``n`` terms of each group: ``key, rank, term, weight``."""
    return heaviest(group_weights(weighted, key), key, n)


def heaviest(weights: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` terms of each group by weight, ties by term. Terms without weight are left out."""
    first = Window.partitionBy(key).orderBy(F.desc(F.round("weight", 9)), "term")
    return (
        weights.where(F.col("weight") > 0)
        .withColumn("rank", F.row_number().over(first))
        .where(F.col("rank") <= n)
        .select(key, "rank", "term", "weight")
    )


def keyword_lists(ranked: DataFrame, key: str) -> DataFrame:
    """Keywords of a group in one array, heaviest first."""
    listed = F.sort_array(F.collect_list(F.struct("rank", "term")))
    return ranked.groupBy(key).agg(listed.alias("_k")).select(key, F.col("_k.term").alias("keywords"))
