"""The similar search repeated for every ticket of a table: exact, or on likely neighbours only."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.fixed_values import SIMILAR_K, SIMILAR_THRESHOLD
from caseloom.functions.text import non_blank
from caseloom.operators.joins import hot_keys, salted_join
from caseloom.operators.scans import recent
from caseloom.operators.scoring import (
    BLOCK_ROWS,
    CELL_ROWS,
    Rule,
    grid,
    hit_schema,
    ranked,
    score_cells,
    top_k,
    unit_rows,
)
from caseloom.session import shared_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Chance that the index finds a pair right at the threshold; nearer pairs are found more often.
RECALL = 0.95
#: Pairs that are scored in the time it takes to deal a row to one more bucket.
PAIRS_PER_COPY = 500
MAX_BITS = 24
#: Share of all pairs from which on it is cheaper to score each of them once than to deal copies of vectors to buckets.
DENSE = 1 / 8
_SAMPLE = 4000


class Index(NamedTuple):
    """An index by sign bits: how many bits tell a bucket of a band, how many bands there are, and in how many buckets of a
    band a query looks besides its own, those beyond the planes that it is nearest to."""

    bits: int
    bands: int
    probes: int

    @classmethod
    def of(
        cls, rows: int, threshold: float, recall: float = RECALL, bits: int | None = None, probes: int | None = None
    ) -> Index:
        """The cheapest index over ``rows`` vectors that finds a pair at the threshold with chance ``recall``.

        Its cost for a query is the copies dealt to buckets and the pairs scored there. Where the threshold is too low for
        buckets to pay, there is one bucket and the search is exact. ``bits`` and ``probes`` settle these themselves.
        """
        best = None
        for n in [bits] if bits is not None else range(MAX_BITS + 1):
            for k, met in enumerate(chances(n, threshold)):
                if probes is not None and k != probes:
                    continue
                bands = 1 if met >= recall else math.ceil(math.log(1 - recall) / math.log(1 - met))
                cost = bands * ((2 + k) * PAIRS_PER_COPY + (1 + k) * rows / 2**n)
                if best is None or cost < best[0]:
                    best = cost, cls(n, bands, k)
        if best is None:
            raise ValueError(f"no more than {bits} buckets can be looked into besides the own")
        return best[1]


def chances(bits: int, threshold: float) -> list[float]:
    """The chance that a pair at the threshold meets in one band, by the number of buckets probed besides the own.

    A unit vector at cosine t to a query that lies m from a plane (in normal units) is beyond that plane with chance
    Phi(-m t / sqrt(1 - t^2)). Averaged over sampled distances m; the planes nearest to the query are crossed first.
    """
    if not -1 < threshold < 1:
        return [1.0 if threshold >= 1 else 0.0 if bits else 1.0]
    distances = np.sort(np.abs(np.random.RandomState(7).standard_normal((_SAMPLE, bits))), axis=1)
    slope = threshold / math.sqrt(2 * (1 - threshold**2))
    grid = np.linspace(0, 6, 2001)
    crossed = np.interp(distances, grid, [0.5 * math.erfc(m * slope) for m in grid])
    same = np.prod(1 - crossed, axis=1)
    one_off = np.cumsum(same[:, None] * crossed / (1 - crossed), axis=1)
    return [float(same.mean()), *(float((same + one_off[:, k]).mean()) for k in range(bits))]


class Bands(NamedTuple):
    """The buckets of unit vectors, by band, and the buckets that they look into as queries."""

    planes: np.ndarray
    index: Index

    def own(self, unit: np.ndarray) -> np.ndarray:
        return self.looked(unit, 0)[:, :, 0]

    def looked(self, unit: np.ndarray, probes: int | None = None) -> np.ndarray:
        bits, bands, most = self.index
        values = 1 << np.arange(bits, dtype=np.int64)
        sides = (unit @ self.planes.T).reshape(len(unit), bands, bits)
        own = ((sides >= 0) @ values)[:, :, None]
        nearest = np.argsort(np.abs(sides), axis=2, kind="stable")[:, :, :most if probes is None else probes]
        return np.concatenate([own, own ^ values[nearest]], axis=2)


def planes_of(index: Index, dim: int, seed: int) -> np.ndarray:
    """The normals of the planes, as many as there are bits in all bands."""
    return np.random.RandomState(seed).standard_normal((index.bands * index.bits, dim))


def similar_for_all(
    tickets: DataFrame,
    threshold: float = SIMILAR_THRESHOLD,
    k: int = SIMILAR_K,
    block_rows: int = BLOCK_ROWS,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """The ``k`` most similar tickets of every ticket, itself left out: ``query_id, id, score, rank``."""
    usable, kept, asking = without_copies(tickets, k)
    found = top_k(asking, kept, Rule(threshold, k + 1), block_rows, cell_rows).hits
    return for_copies(usable, asking, found, k)


def likely_similar_for_all(
    tickets: DataFrame,
    dim: int,
    threshold: float = SIMILAR_THRESHOLD,
    k: int = SIMILAR_K,
    bands: int | None = None,
    bits: int | None = None,
    probes: int | None = None,
    recall: float = RECALL,
    seed: int = 42,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Like ``similar_for_all``, but scoring only tickets that share a bucket of sign bits.

    The index is laid out for the number of tickets, so that a neighbour right at the threshold is found with chance
    ``recall``: an approximation for tables too large to score all against all, with scores exact for what is found.
    ``bits`` and ``probes`` settle parts of the layout, and with ``bands`` all of it. Vectors are dealt to their buckets, and a
    bucket of more than ``cell_rows`` tickets is split into a grid. Where the buckets hold a good share of all pairs, vectors
    are stored once instead, blocks of them meet each other, and of their pairs those count that share a bucket.
    """
    usable, kept, asking = without_copies(tickets, k)
    rows, ids = kept.agg(F.count(F.lit(1)), F.count_distinct("id")).first()
    if bands is None:
        index = Index.of(rows, threshold, recall, bits, probes)
    else:
        index = Index(bits or 0, bands, probes or 0)
    planes = planes_of(index, dim, seed)
    rule = Rule(threshold, k + 1)
    # Where ids come again, every bucket has its own best of them.
    if ids == rows and index.bands * (1 + index.probes) >= DENSE * 2**index.bits:
        found = grid(asking, kept, rule, cell_rows, Bands(planes, index))
        return for_copies(usable, asking, found, k)
    there = _with_bands(kept.select("id", "ts", "embedding"), "embedding", planes, index, 0)
    here = _with_bands(asking.select("query_id", "query_vec"), "query_vec", planes, index, index.probes)
    down = _splits(there, cell_rows, "_down")
    across = _splits(here, cell_rows, "_across")
    found = score_cells(
        _in_cells(here, "query_id", down, across, deal="_across", repeat="_down"),
        _in_cells(there, "id", down, across, deal="_down", repeat="_across"),
        ["_band", "_bucket", "_down", "_across"],
        rule,
        hit_schema(asking.schema, kept.schema),
    )
    return for_copies(usable, asking, ranked(found.dropDuplicates(["query_id", "id"]), rule), k)


def without_copies(tickets: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All usable tickets, those that can be hits, and those that ask for all with their vector.

    Of tickets with one and the same vector only the newest k+1 can be among anyone's best k, and the
    newest of them asks for all. Both are exact, and a vector shared by a third of the table costs no
    more than any other: the surplus is dropped before the shuffle. What is left is checkpointed, as it is
    counted, dealt out and asked in turn.
    """
    usable = recent(tickets, None).where(non_blank(F.col("summary")) & (F.size("embedding") > 0))
    usable = usable.select("id", "ts", "embedding", _vector_key().alias("_vector"))
    newest = Window.partitionBy("_vector").orderBy(F.desc("ts"), F.desc("id"))
    shared_dir(tickets.sparkSession)
    kept = usable.withColumn("_copy", F.row_number().over(newest)).where(F.col("_copy") <= k + 1).checkpoint()
    asking = kept.where(F.col("_copy") == 1).select(
        F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"), "_vector"
    )
    return usable.select("id", "_vector").checkpoint(), kept, asking


def _vector_key():
    """A short stand-in for a vector, to find copies by without shuffling the vectors of all tickets."""
    return F.sha2(F.col("embedding").cast("string"), 256)


def for_copies(usable: DataFrame, asking: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Hand the k+1 hits of one asker to every ticket with the same vector, each without itself."""
    lists = found.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("_hits")
    )
    answers = asking.select("query_id", "_vector").join(lists, "query_id").select("_vector", "_hits")
    own = F.filter("_hits", lambda hit: hit["id"] != F.col("query_id"))
    # Lists of hits are wide: only those of vectors with very many copies are repeated.
    hot = hot_keys(usable, "_vector")
    return (
        salted_join(usable.withColumnRenamed("id", "query_id"), answers, "_vector", F.col("query_id"), hot=hot)
        .select("query_id", F.posexplode(F.slice(own, 1, k)).alias("_at", "_hit"))
        .select(
            "query_id", F.col("_hit.id").alias("id"), F.col("_hit.score").alias("score"),
            (F.col("_at") + 1).alias("rank"),
        )
    )


def _with_bands(df: DataFrame, vector: str, planes: np.ndarray, index: Index, probes: int) -> DataFrame:
    """One row per band and bucket: the bucket the vector falls into, and those beyond its ``probes`` nearest planes."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets = Bands(planes, index).looked(unit_rows(batch.column(vector)), probes).reshape(len(batch), -1)
            offsets = np.arange(0, buckets.size + 1, buckets.shape[1], dtype=np.int32)
            column = pa.ListArray.from_arrays(offsets, buckets.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "_buckets"])

    schema = df.limit(0).withColumn("_buckets", F.array().cast("array<bigint>")).schema
    marked = df.mapInArrow(sign, schema).select(*df.columns, F.posexplode("_buckets").alias("_at", "_bucket"))
    return marked.withColumn("_band", F.floor(F.col("_at") / (1 + probes)).cast("int")).drop("_at")


def _splits(rows: DataFrame, cell_rows: int, name: str) -> DataFrame:
    """Into how many parts each over-full bucket goes; there are at most rows/cell_rows of them."""
    sizes = rows.groupBy("_band", "_bucket").count().where(F.col("count") > cell_rows)
    return sizes.select("_band", "_bucket", F.ceil(F.col("count") / cell_rows).cast("int").alias(name))


def _in_cells(
    rows: DataFrame, key: str, down: DataFrame, across: DataFrame, deal: str, repeat: str
) -> DataFrame:
    """Deal rows to one side of the cells of their bucket and repeat them along the other."""
    placed = rows.join(down, ["_band", "_bucket"], "left").join(across, ["_band", "_bucket"], "left")
    parts = {name: F.coalesce(F.col(name), F.lit(1)) for name in ("_down", "_across")}
    return placed.withColumns(
        {deal: F.pmod(F.xxhash64(key), parts[deal]).cast("int"), repeat: parts[repeat]}
    ).withColumn(repeat, F.explode(F.sequence(F.lit(0), F.col(repeat) - 1)))
