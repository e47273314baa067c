"""Near copies among vectors by randomly rotated binary codes, whose error bounds leave few pairs to compare exactly.

Every distinct vector is turned by one random rotation (into more dimensions where it has few) and keeps the signs. With
the code goes a correction factor, the inner product of the unit vector x and its code c. For another unit vector
y, ``<c, y> / <c, x>`` estimates ``<x, y>`` without bias, and its error shrinks with the root of the code's length: a pair
whose estimate is below the threshold by more than its confidence bound is left out. The other side y travels in four
bits a component, rounded at random so that the estimate stays unbiased; its share of the error is in the bound.

Pairs meet where they share a band of sign bits. Width and number of the bands follow from the number of vectors, the
threshold and the recall asked for. What is left inside a bucket is passed on as stars around its groups, never as pairs.
The groups that these make are then compared exactly, each vector sent there once: in blocks if they are large.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import components, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

THRESHOLD = 0.9
#: Chance that a pair right at the threshold shares a band; nearer pairs nearly always do.
RECALL = 0.99
#: Standard deviations of the estimate's error that a pair may be short of the threshold.
CONFIDENCE = 4.0
#: Vectors a bucket should hold, and the most that a side of a cell holds.
BUCKET_ROWS = 256
CELL_ROWS = 512
#: Shortest code.
MIN_CODE_BITS = 128
SEED = 13
#: Split buckets or groups that may be sent to all tasks.
BROADCAST_ROWS = 100_000

_CODED = (
    "rep long, copies long, vec array<double>, dim int, code binary, factor double, query binary, low double, "
    "step double, buckets array<long>"
)


class Layout(NamedTuple):
    """Bands and code length for a number of vectors, a threshold and a recall."""

    bits: int
    bands: int
    code_bits: int

    @classmethod
    def of(cls, vectors: int, threshold: float, recall: float, bucket_rows: int = BUCKET_ROWS) -> Layout:
        bits = min(40, max(0, math.ceil(math.log2(max(1, vectors) / bucket_rows))))
        shared = (1 - math.acos(threshold) / math.pi) ** bits
        bands = 1 if shared >= recall else math.ceil(math.log(1 - recall) / math.log(1 - shared))
        return cls(bits, bands, 64 * -(-max(MIN_CODE_BITS, bits * bands) // 64))

    def code_length(self, dim: int) -> int:
        return max(self.code_bits, 64 * -(-dim // 64))


def near_vectors(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    bucket_rows: int = BUCKET_ROWS,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Two vectors are linked if they are found with a cosine of ``threshold`` or more, reckoned in double precision.
    ``n_links`` counts the other vectors linked directly, ``component_id`` is the smallest id reached by links, and
    ``kept`` tells the one vector of each component that has it.

    Vectors that are null, empty, zero or hold null or non-finite components are linked with nothing. Vectors of
    different lengths are never linked. Equal vectors are compared once, however many there are. Rows that repeat an id
    count as one vector; should they hold different ones, it is the one with the smallest hash. Rows without an id are
    linked with nothing and kept. Jobs run while the table is being made.
    """
    if not 0 < threshold < 1 or not 0 < recall < 1:
        raise ValueError("threshold and recall lie between 0 and 1")
    vec = F.col("vec")
    usable = (
        F.col("vec_id").isNotNull()
        & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(vec, lambda x: x != 0)
    )
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec")
    )
    keyed = rows.where(usable).withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(7), "vec")})
    members = stored(
        keyed.groupBy("vec_id").agg(F.min(F.struct("h1", "h2")).alias("h")).select("vec_id", "h.h1", "h.h2"), "members"
    )
    classes = stored(
        members.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes"
    )
    layout = Layout.of(classes.count(), threshold, recall, bucket_rows)
    distinct = (
        keyed.join(classes.withColumnRenamed("rep", "vec_id"), ["vec_id", "h1", "h2"])
        .dropDuplicates(["vec_id", "h1", "h2"])
        .select(F.col("vec_id").alias("rep"), "copies", "vec")
    )
    coded = stored(distinct.mapInArrow(_coder(layout), _CODED), "codes")
    candidates = components(_candidates(coded, layout, threshold, cell_rows))
    compared = stored(_compared(coded.select("rep", "copies", "vec"), candidates, threshold, cell_rows), "compared")
    links = components(compared.where(F.col("b").isNotNull()).select("a", "b"))
    counts = compared.where(F.col("b").isNull()).groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    found = (
        classes.join(counts, "rep", "left")
        .join(links.select(F.col("id").alias("rep"), "root"), "rep", "left")
        .select(
            "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("root", "rep").alias("component_id"),
        )
    )
    answers = members.join(found, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    return (
        rows.select("vec_id").join(answers, "vec_id", "left")
        .select(
            "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )


_ROTATIONS: dict[tuple[int, int], np.ndarray] = {}


def _rotation(dim: int, length: int) -> np.ndarray:
    """``length`` x ``dim`` with orthonormal columns, the same in every task."""
    if (dim, length) not in _ROTATIONS:
        random = np.random.default_rng([SEED, dim, length]).standard_normal((length, dim))
        _ROTATIONS[dim, length] = np.linalg.qr(random)[0]
    return _ROTATIONS[dim, length]


def _units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that no square is lost."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _coder(layout: Layout):
    """Unit vectors to codes, correction factors, four-bit forms and buckets."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("vec").value_lengths())
            for dim in np.unique(dims).tolist():
                yield _coded(batch.filter(pa.array(dims == dim)), dim, layout)

    return code


def _coded(batch: pa.RecordBatch, dim: int, layout: Layout) -> pa.RecordBatch:
    length = layout.code_length(dim)
    units = _units(_matrix(batch.column("vec"), dim))
    turned = units @ _rotation(dim, length).T
    signs = turned >= 0
    factor = np.abs(turned).sum(axis=1) / math.sqrt(length)
    low, high = units.min(axis=1), units.max(axis=1)
    step = np.where(high > low, (high - low) / 15, 1.0)
    # The same vector is rounded in the same way wherever its task runs.
    dither = _even(batch.column("rep").to_numpy(), dim)
    levels = np.clip(np.floor((units - low[:, None]) / step[:, None] + dither), 0, 15).astype(np.uint8)
    if dim % 2:
        levels = np.pad(levels, ((0, 0), (0, 1)))
    packed = levels[:, ::2] << 4 | levels[:, 1::2]
    bands = signs[:, :layout.bits * layout.bands].reshape(len(units), layout.bands, layout.bits)
    buckets = bands @ (np.int64(1) << np.arange(layout.bits, dtype=np.int64))
    offsets = np.arange(0, len(units) * layout.bands + 1, layout.bands, dtype=np.int32)
    bits = np.packbits(signs, axis=1)
    return pa.RecordBatch.from_arrays(
        [
            *(batch.column(name) for name in ("rep", "copies", "vec")), pa.array(np.full(len(units), dim, np.int32)),
            pa.array([row.tobytes() for row in bits], pa.binary()), pa.array(factor),
            pa.array([row.tobytes() for row in packed], pa.binary()), pa.array(low), pa.array(step),
            pa.ListArray.from_arrays(offsets, pa.array(buckets.astype(np.int64).ravel())),
        ],
        names=["rep", "copies", "vec", "dim", "code", "factor", "query", "low", "step", "buckets"],
    )


def _even(ids: np.ndarray, dim: int) -> np.ndarray:
    """Numbers spread evenly over 0 to 1, made from the id and the component alone."""
    x = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, dim + 1, dtype=np.uint64) * np.uint64(
        0xBF58476D1CE4E5B9
    )
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


def _dealt(rows: DataFrame, keys: list[str], cell_rows: int) -> DataFrame:
    """Rows with ``_i``, ``_j`` and ``_part``: whole groups, or the cells of a grid for groups over ``cell_rows``.

    A group in p parts has p (p + 1) / 2 cells; each row goes to the p that its part has a side in.
    """
    large = stored(
        rows.groupBy(*keys).count().where(F.col("count") > cell_rows)
        .select(*keys, F.ceil(F.col("count") / cell_rows).cast("int").alias("_parts")),
        "large",
    )
    n = large.count()
    if n == 0:
        return rows.withColumns({"_i": F.lit(0), "_j": F.lit(0), "_part": F.lit(0)})
    placed = rows.join(F.broadcast(large) if n <= BROADCAST_ROWS else large, keys, "left")
    parts = F.coalesce("_parts", F.lit(1))
    return (
        placed.withColumn("_part", F.pmod(F.xxhash64("rep"), parts).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .withColumns({"_i": F.least("_part", "_other"), "_j": F.greatest("_part", "_other")})
        .drop("_parts", "_other")
    )


def _candidates(coded: DataFrame, layout: Layout, threshold: float, cell_rows: int) -> DataFrame:
    """``a, b``: links that connect what the estimates cannot tell from linked vectors."""
    banded = coded.select(
        "rep", "dim", "code", "factor", "query", "low", "step", F.posexplode("buckets").alias("band", "bucket")
    )
    keys = ["dim", "band", "bucket"]
    dealt = _dealt(banded, keys, cell_rows)

    def connect(cell: pa.Table) -> pa.Table:
        if cell.num_rows < 2:
            return _edges([], [])
        dim = cell["dim"][0].as_py()
        length = layout.code_length(dim)
        rows = cell.num_rows
        packed = np.frombuffer(b"".join(cell["query"].to_pylist()), np.uint8).reshape(rows, -1)
        levels = np.stack([packed >> 4, packed & 15], axis=2).reshape(rows, -1)[:, :dim]
        low, step, factor = (cell[name].to_numpy() for name in ("low", "step", "factor"))
        turned = (low[:, None] + levels * step[:, None]) @ _rotation(dim, length).T
        bits = np.frombuffer(b"".join(cell["code"].to_pylist()), np.uint8).reshape(rows, -1)
        codes = (np.unpackbits(bits, axis=1)[:, :length] * 2.0 - 1) / math.sqrt(length)
        estimate = turned.astype(np.float32) @ codes.astype(np.float32).T / factor
        # The code's error lies across x: of y it meets the part across x, which is short near the threshold.
        error = (1 / factor**2 - 1) * (1 - threshold**2) / (length - 1) + (step[:, None] / (2 * factor)) ** 2
        near = estimate >= threshold - CONFIDENCE * np.sqrt(error)
        near &= near.T
        return _edges(*_stars(cell["rep"].to_numpy(), _across(near, cell)))

    return dealt.groupBy(*keys, "_i", "_j").applyInArrow(connect, "a long, b long")


def _across(near: np.ndarray, cell: pa.Table) -> np.ndarray:
    """Which pairs count here: none with itself, and only those of both parts where the cell has two."""
    np.fill_diagonal(near, False)
    if cell["_i"][0].as_py() != cell["_j"][0].as_py():
        part = cell["_part"].to_numpy()
        near &= part[:, None] != part
    return near


def _stars(ids: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id that is connected to a smaller one, and the smallest that it is connected to."""
    there = np.flatnonzero(near.any(axis=1))
    there = there[np.argsort(ids[there], kind="stable")]
    near = near[np.ix_(there, there)]
    root = np.arange(len(there))
    while len(there):
        least = np.where(near, root, len(there)).min(axis=1)
        now = np.minimum(root, least)
        now = now[now]
        if (now == root).all():
            break
        root = now
    ids = ids[there]
    others = root != np.arange(len(there))
    return ids[others], ids[root[others]]


def _edges(a, b) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _compared(vectors: DataFrame, groups: DataFrame, threshold: float, cell_rows: int) -> DataFrame:
    """``a, b, n``: with b, links that connect linked vectors; without, how many vectors ``a`` is linked to here."""
    sent = vectors.join(groups.select(F.col("id").alias("rep"), "root"), "rep")
    dealt = _dealt(sent, ["root"], cell_rows)

    def compare(cell: pa.Table) -> pa.Table:
        ids, copies = cell["rep"].to_numpy(), cell["copies"].to_numpy()
        dim = len(cell["vec"][0])
        units = _units(_matrix(cell["vec"], dim))
        near = _across(units @ units.T >= threshold, cell)
        counts = near @ copies
        linked = np.flatnonzero(counts)
        a, b = _stars(ids, near)
        return pa.table({
            "a": pa.array(np.concatenate([a, ids[linked]]), pa.int64()),
            "b": pa.array([*b.tolist(), *[None] * len(linked)], pa.int64()),
            "n": pa.array(np.concatenate([np.zeros(len(a), np.int64), counts[linked]]), pa.int64()),
        })

    return dealt.groupBy("root", "_i", "_j").applyInArrow(compare, "a long, b long, n long")
