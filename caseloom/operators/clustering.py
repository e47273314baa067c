"""K-means over TF-IDF features, a two-dimensional projection, and nearest-centroid assignment."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.fixed_values import (
    KMEANS_RESTARTS,
    KMEANS_SEED,
    MAX_DF,
    MAX_FEATURES,
    MIN_DF,
    N_CLUSTERS,
    TOP_KEYWORDS,
)
from caseloom.operators.tfidf import heaviest, tokenised, unit_vectors, vocabulary_of
from caseloom.session import shared_dir, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Centroids that go to the tasks at a time, and numbers of a matrix there.
CENTROIDS_AT_ONCE = 4096
CELLS_AT_ONCE = 4_000_000
#: Numbers of a matrix that vectors are laid out in: it stays in a core's cache while it is multiplied.
BLOCK_CELLS = 1_000_000
#: Vectors that k-means runs pick their first centres from.
START_ROWS = 2048
#: Directions multiplied at a time, most passes, and the error left, as a share of the largest variance.
PCA_BLOCK = 8
PCA_PASSES = 40
PCA_TOLERANCE = 1e-8
#: Features whose sums are added up in one group.
PCA_FEATURES = 256


def text_features(
    docs: DataFrame,
    text: str,
    stop_words: Sequence[str],
    max_features: int = MAX_FEATURES,
    min_df: int = MIN_DF,
    max_df: float = MAX_DF,
    keep: Sequence[str] = ("id",),
) -> tuple[DataFrame, list[str]]:
    """TF-IDF vectors of unit length next to the columns to keep, and the terms of their positions.

    Texts are tokenised once. The vocabulary, at most ``max_features`` terms, is found first; the vectors then need no
    shuffle. They are checkpointed: clustering goes over them many times, and neither that nor the loss of an
    executor repeats the text work.
    """
    split = tokenised(docs, text, stop_words, keep)
    terms = vocabulary_of(split, max_features, min_df, max_df).orderBy("term").collect()
    if not terms:
        raise ValueError("no term is frequent enough to describe the documents")
    shared_dir(docs.sparkSession)
    return unit_vectors(split, terms, keep).checkpoint(), [t["term"] for t in terms]


class Clusters(NamedTuple):
    """Centres, one a row, and the squared distances of all vectors to the nearest ones, summed."""

    centres: np.ndarray
    trainingCost: float

    @property
    def summary(self) -> Clusters:
        """Where Spark's own models have their cost."""
        return self


def kmeans(
    features: DataFrame,
    k: int = N_CLUSTERS,
    restarts: int = KMEANS_RESTARTS,
    seed: int = KMEANS_SEED,
    max_iter: int = 300,
    tolerance: float = 1e-4,
    start: Sequence[np.ndarray] = (),
) -> Clusters:
    """The best of several K-means runs by their summed squared distances.

    All runs take each step together: one pass over the vectors finds the nearest centre in every run, sums the vectors
    of every centre in the tasks, and one aggregation adds these sums. A run ends when no centre moves by more
    than ``tolerance``. Runs begin with centres of ``start`` or, each with its own seed, with vectors far apart out of a
    sample of ``START_ROWS``; all vectors count in every step. Centres, runs x k x features, are on the driver.
    """
    points = _cells(features).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        runs = [np.asarray(centres, float) for centres in start] or _starts(points, k, restarts, seed)
        going = list(range(len(runs)))
        costs = [math.inf] * len(runs)
        for _ in range(max_iter):
            moved = _step(points, [runs[i] for i in going])
            still = []
            for i, (centres, cost) in zip(going, moved):
                furthest = np.sqrt(((centres - runs[i]) ** 2).sum(axis=1).max())
                runs[i], costs[i] = centres, cost
                if furthest > tolerance:
                    still.append(i)
            going = still
            if not going:
                break
        for i, (_, cost) in enumerate(_step(points, runs)):
            costs[i] = cost
        best = int(np.argmin(costs))
        return Clusters(runs[best], costs[best])
    finally:
        points.unpersist()


def _cells(features: DataFrame) -> DataFrame:
    """Vectors as their places and values; places are null for vectors that hold every value."""
    vector = F.unwrap_udt("features")
    return features.select(vector["indices"].alias("indices"), vector["values"].alias("values"))


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[np.ndarray]:
    """The vectors of batches as the rows of matrices of bounded size. Places beyond ``size`` are left out."""
    step = max(1, BLOCK_CELLS // size)
    for batch in batches:
        for begin in range(0, len(batch), step):
            part = batch.slice(begin, step)
            indices, values = part.column("indices"), part.column("values")
            x = np.zeros((len(part), size))
            lengths = np.asarray(values.value_lengths())
            row = np.repeat(np.arange(len(part)), lengths)
            place = indices.flatten().to_numpy(zero_copy_only=False)
            if indices.null_count:
                sparse = np.repeat(indices.is_valid().to_numpy(zero_copy_only=False), lengths)
                every = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                every[sparse] = place
                place = every
            found = values.flatten().to_numpy(zero_copy_only=False)
            if len(place) and place.max() >= size:
                inside = place < size
                row, place, found = row[inside], place[inside], found[inside]
            x[row, place] = found
            yield x


def _starts(points: DataFrame, k: int, restarts: int, seed: int) -> list[np.ndarray]:
    """For each run, vectors of a sample picked one by one with chances by their squared distance to those picked."""
    order = F.xxhash64("indices", "values", F.lit(seed))
    sample = points.orderBy(order).limit(START_ROWS).toArrow().combine_chunks()
    if sample.num_rows == 0:
        raise ValueError("no vectors to cluster")
    x = _dense(sample, _size(points))
    runs = []
    for i in range(restarts):
        random = np.random.default_rng([seed, i])
        picked = [x[random.integers(len(x))]]
        nearest = ((x - picked[0]) ** 2).sum(axis=1)
        while len(picked) < k and nearest.max() > 1e-12:
            picked.append(x[random.choice(len(x), p=nearest / nearest.sum())])
            nearest = np.minimum(nearest, ((x - picked[-1]) ** 2).sum(axis=1))
        runs.append(np.array(picked))
    return runs


def _size(points: DataFrame) -> int:
    """The number of places of the vectors that is in use."""
    last = F.coalesce(F.element_at("indices", -1) + 1, F.size("values"))
    return max(1, points.where(F.size("values") > 0).agg(F.max(last)).head()[0] or 1)


def _dense(table: pa.Table, size: int) -> np.ndarray:
    return np.concatenate([*_blocks(table.to_batches(), size), np.zeros((0, size))])


def _step(points: DataFrame, runs: list[np.ndarray]) -> list[tuple[np.ndarray, float]]:
    """The means of the vectors nearest to each centre of each run, and the cost of the centres as they were."""
    size = runs[0].shape[1]
    centres = np.concatenate(runs)
    bounds = np.cumsum([0, *map(len, runs)])
    held = points.sparkSession.sparkContext.broadcast((centres, bounds))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, bounds = held.value
        squares = (centres**2).sum(axis=1)
        sums, counts, costs = np.zeros_like(centres), np.zeros(len(centres), np.int64), np.zeros(len(centres))
        for x in _blocks(batches, centres.shape[1]):
            distances = squares - 2 * (x @ centres.T)
            own = np.einsum("ij,ij->i", x, x)
            chosen = np.zeros_like(distances)
            for begin, end in zip(bounds[:-1], bounds[1:]):
                best = distances[:, begin:end].argmin(axis=1) + begin
                every = np.arange(len(x))
                chosen[every, best] = 1
                costs += np.bincount(best, np.maximum(own + distances[every, best], 0), len(centres))
            sums += chosen.T @ x
            counts += chosen.sum(axis=0).astype(np.int64)
        used = np.flatnonzero(counts)
        offsets = np.arange(0, len(used) * sums.shape[1] + 1, sums.shape[1], dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(used.astype(np.int32)), pa.array(counts[used]), pa.array(costs[used]),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(sums[used].ravel())),
            ],
            names=["centre", "n", "cost", "total"],
        )

    parts = points.mapInArrow(nearest, "centre int, n long, cost double, total array<double>")
    rows = parts.groupBy("centre").agg(
        F.sum("n").alias("n"), F.sum("cost").alias("cost"),
        vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total"),
    ).collect()
    held.unpersist()
    moved, costs = centres.copy(), np.zeros(len(centres))
    for row in rows:
        moved[row["centre"]] = np.array(row["total"]) / row["n"]
        costs[row["centre"]] = row["cost"]
    return [
        (moved[begin:end].reshape(-1, size), float(costs[begin:end].sum())) for begin, end in zip(bounds[:-1], bounds[1:])
    ]


def labelled(features: DataFrame, clusters: Clusters) -> DataFrame:
    """The vectors, and the columns next to them, with their ``cluster``: the nearest centre, of equals the first."""
    centres = np.asarray(clusters.centres, float)
    squares = (centres**2).sum(axis=1)

    @F.arrow_udf("int")
    def nearest(indices: pa.Array, values: pa.Array) -> pa.Array:
        vectors = pa.RecordBatch.from_arrays([indices, values], names=["indices", "values"])
        found = [np.round(squares - 2 * (x @ centres.T), 9).argmin(axis=1) for x in _blocks([vectors], centres.shape[1])]
        return pa.array(np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int32))

    vector = F.unwrap_udt("features")
    return features.withColumn("cluster", nearest(vector["indices"], vector["values"]))


def _along(axis: np.ndarray) -> Column:
    """The inner products of the sparse vectors with one axis."""
    vector = F.unwrap_udt("features")
    loadings = F.lit(np.ascontiguousarray(axis))
    # Vectors that hold every value have no places.
    places = F.coalesce(vector["indices"], F.sequence(F.lit(0), F.size(vector["values"]) - 1))
    products = F.zip_with(places, vector["values"], lambda i, x: x * F.coalesce(F.get(loadings, i), F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cluster_keywords(labelled: DataFrame, names: Sequence[str], n: int = TOP_KEYWORDS) -> DataFrame:
    """The heaviest ``n`` terms of each cluster by summed weight: ``cluster, rank, term, weight``.

    Vectors are summed in the tasks that hold them, so one vector per task and cluster is shuffled.
    """
    sums = labelled.groupBy("cluster").agg(vector_to_array(Summarizer.sum(F.col("features"))).alias("_sum"))
    weights = sums.select("cluster", F.posexplode("_sum").alias("_at", "weight")).where(F.col("weight") > 0)
    terms = labelled.sparkSession.createDataFrame(list(enumerate(names)), "_at int, term string")
    # As many rows as there are features.
    return heaviest(weights.join(F.broadcast(terms), "_at"), "cluster", n)


def principal_axes(features: DataFrame, n: int = 2, tolerance: float = PCA_TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` principal components, as columns, and the mean vector.

    A block of random directions is multiplied by the covariance again and again, one pass over the sparse vectors each
    time, and the components are sought in all that came of it (block Krylov). Passes end when the
    components solve their equation to ``tolerance``. What is on the driver has as many rows as there are features
    and ``PCA_BLOCK`` columns a pass; the covariance is never made. Of the two signs of a component the one with the
    largest loading positive is used.
    """
    points = _cells(features).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        mean = features.agg(Summarizer.mean(F.col("features")).alias("m")).head()["m"].toArray()
        size, rows = len(mean), points.count()
        block = np.linalg.qr(np.random.default_rng(KMEANS_SEED).standard_normal((size, min(size, PCA_BLOCK))))[0]
        basis, turned = np.zeros((size, 0)), np.zeros((size, 0))
        for _ in range(PCA_PASSES):
            product = _gram_times(points, block) / rows - np.outer(mean, mean @ block)
            basis, turned = np.hstack([basis, block]), np.hstack([turned, product])
            inside = basis.T @ turned
            values, vectors = np.linalg.eigh((inside + inside.T) / 2)
            top = vectors[:, ::-1][:, :n]
            axes, largest = basis @ top, max(abs(values[-1]), 1e-300)
            off = np.linalg.norm(turned @ top - axes * values[::-1][:n], axis=0).max() / largest
            if off < tolerance or basis.shape[1] >= size:
                break
            # What the covariance adds to the directions so far, twice cleared of them.
            fresh = product - basis @ (basis.T @ product)
            fresh -= basis @ (basis.T @ fresh)
            block, spread = np.linalg.qr(fresh)
            block = block[:, np.abs(np.diag(spread)) > 1e-12 * largest][:, : size - basis.shape[1]]
            if block.shape[1] == 0:
                break
            block -= basis @ (basis.T @ block)
            block = np.linalg.qr(block)[0]
        axes = np.hstack([axes, np.zeros((size, n - axes.shape[1]))])
        signs = axes[np.abs(axes).argmax(axis=0), np.arange(n)]
        return axes * np.where(signs < 0, -1.0, 1.0), mean
    finally:
        points.unpersist()


def _gram_times(points: DataFrame, block: np.ndarray) -> np.ndarray:
    """The sum over all vectors x of x (x' block): one pass, summed in the tasks, added up by groups of features."""
    size, width = block.shape
    held = points.sparkSession.sparkContext.broadcast(block)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, width))
        for x in _blocks(batches, size):
            total += x.T @ (x @ held.value)
        begins = np.arange(0, size, PCA_FEATURES)
        parts = [total[b:b + PCA_FEATURES].ravel().tolist() for b in begins.tolist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(begins.astype(np.int64)), pa.array(parts, pa.list_(pa.float64()))], names=["begin", "part"]
        )

    parts = points.mapInArrow(multiply, "begin long, part array<double>")
    rows = parts.groupBy("begin").agg(vector_to_array(Summarizer.sum(array_to_vector("part"))).alias("part")).collect()
    held.unpersist()
    result = np.zeros((size, width))
    for row in rows:
        part = np.array(row["part"]).reshape(-1, width)
        result[row["begin"]:row["begin"] + len(part)] = part
    return result


def project_2d(
    features: DataFrame, keep: Sequence[str] = ("id",), tolerance: float = PCA_TOLERANCE
) -> DataFrame:
    """Centred coordinates on the first two principal components, ``x, y``, next to the columns to keep.

    The sparse vectors are projected as they are and the mean is taken off afterwards, so they never
    become dense.
    """
    axes, mean = principal_axes(features, tolerance=tolerance)
    along = [(_along(axis) - float(axis @ mean)).alias(name) for axis, name in zip(axes.T, "xy")]
    return features.select(*keep, *along)


def mean_vectors(points: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector per label: ``label, centroid``."""
    mean = Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))
    return points.groupBy(label).agg(vector_to_array(mean).alias("centroid"))


def assign(points: DataFrame, vector: str, centroids: DataFrame, label: str) -> DataFrame:
    """Nearest centroid of every point: adds ``cluster`` and ``distance``; ties go to the lower label.

    The centroids, ``label, centroid``, are read a block of ``CENTROIDS_AT_ONCE`` at a time: each goes to every task, and
    points carry the best so far from one block to the next. The points stay where they are.
    """
    ordered = written(centroids.select(label, "centroid").orderBy(label), "centroids")
    kind = centroids.schema[label].dataType
    found = points.where(F.size(vector) > 0).withColumns({
        "cluster": F.lit(None).cast(kind), "distance": F.lit(None).cast("double")
    })
    schema = found.schema
    after = None
    while True:
        left = ordered if after is None else ordered.where(F.col(label) > F.lit(after))
        table = left.orderBy(label).limit(CENTROIDS_AT_ONCE).toArrow()
        if table.num_rows == 0:
            return found
        found = found.mapInArrow(_nearer(points, vector, table, label), schema)
        after = table[label][-1].as_py()
        if table.num_rows < CENTROIDS_AT_ONCE:
            return found


def _nearer(points: DataFrame, vector: str, table: pa.Table, label: str):
    """Keeps for each point the nearer of the centroid it has and the nearest of a block."""
    centres = np.array(table["centroid"].to_pylist(), dtype=np.float64)
    held = points.sparkSession.sparkContext.broadcast((table[label].combine_chunks(), centres))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, centres = held.value
        for batch in batches:
            flat = batch.column(vector).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = flat.reshape(len(batch), -1)
            best, least = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
            step = max(1, CELLS_AT_ONCE // len(centres))
            for begin in range(0, len(x), step):
                part = x[begin:begin + step]
                squares = (part * part).sum(1)[:, None] - 2 * part @ centres.T + (centres * centres).sum(1)
                distance = np.sqrt(np.maximum(np.round(squares, 9), 0))
                best[begin:begin + step] = distance.argmin(axis=1)
                least[begin:begin + step] = distance.min(axis=1)
            so_far = batch.column("distance").to_numpy(zero_copy_only=False)
            nearer = pa.array(~(so_far <= least))
            columns = dict(zip(batch.schema.names, batch.columns))
            columns["cluster"] = pc.if_else(nearer, labels.take(pa.array(best)), columns["cluster"].cast(labels.type))
            columns["distance"] = pc.if_else(nearer, pa.array(least), columns["distance"])
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return nearest
