"""Quality of texts by a generalised additive model with pairwise interactions.

The score of a text is the logistic of a sum of table entries: one table per feature and one per chosen pair
of features, each over bins. The tables are learned by cyclic boosting: in turn each feature gets a tree of a few
leaves on its own bins, added with a small step. The pairs whose four quadrants explain most of what is left
are then boosted the same way. Scoring adds looked-up bins, a batch at a time.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import WHITE, first_hashes, for_python, small_frame, text_lists
from caseloom.llm.distribution_rules import class_counts, repeated_words

FEATURES = (
    "log_words", "word_length", "upper", "letter", "digit", "white", "punctuation", "other", "distinct_words",
    "top_word", "repeated_words", "repeated_lines", "repeated_neighbours", "line_words", "ended_lines", "symbol_words",
    "shouted_words",
)
#: The model may be learned from so many labelled rows, the first by a hash of their id. All rows are scored.
FIT_ROWS = 12_000
BINS = 32
PAIR_BINS = 8
PAIRS = 6
LEAVES = 3
ROUNDS = 120
RATE = 0.15
#: Least weight of a leaf and what is added to it, in units of the logistic loss's curvature.
LEAST_WEIGHT = 2.0
SHRINK = 1.0
FOLDS, HELD_OUT_FOLD = 3, 1


def features(text: str) -> list[float]:
    """What the model knows of a text; an empty one has zeros."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    classes = class_counts(text)
    lower, upper, letter, digit, white, punctuation, other = (classes / len(text)).tolist()
    counted = Counter(words)
    lines = [line for line in text.split("\n") if line.strip(WHITE)]
    return [
        math.log(n),
        (len(text) - sum(map(text.count, WHITE))) / n,
        upper / max(lower + upper, 1e-9),
        lower + upper + letter,
        digit,
        white,
        punctuation,
        other,
        len(counted) / n,
        max(counted.values()) / n,
        repeated_words(words) / n,
        (len(lines) - len(set(lines))) / len(lines),
        sum(map(bytes.__eq__, words, words[1:])) / n,
        math.log(n / len(lines)),
        sum(line.rstrip(WHITE)[-1] in ".!?:;\"')" for line in lines) / len(lines),
        sum(count for word, count in counted.items() if not word.isalnum() and word.isascii() and len(word) == 1) / n,
        sum(count for word, count in counted.items() if word.isupper() and len(word) > 1) / n,
    ]


def _leaves(gradient: np.ndarray, weight: np.ndarray, leaves: int) -> np.ndarray:
    """The best tree of so many leaves over ordered bins: the value of each bin."""
    cuts = [0, len(gradient)]

    def gain(lo: int, hi: int) -> tuple[float, int]:
        g, w = np.cumsum(gradient[lo:hi])[:-1], np.cumsum(weight[lo:hi])[:-1]
        total_g, total_w = gradient[lo:hi].sum(), weight[lo:hi].sum()
        if not len(g):
            return 0.0, lo
        found = g**2 / (w + SHRINK) + (total_g - g) ** 2 / (total_w - w + SHRINK) - total_g**2 / (total_w + SHRINK)
        found = np.where((w >= LEAST_WEIGHT) & (total_w - w >= LEAST_WEIGHT), found, 0.0)
        at = int(found.argmax())
        return float(found[at]), lo + at + 1

    while len(cuts) <= leaves:
        best, at = max(gain(lo, hi) for lo, hi in zip(cuts, cuts[1:]))
        if best <= 0:
            break
        cuts = sorted([*cuts, at])
    values = np.zeros(len(gradient))
    for lo, hi in zip(cuts, cuts[1:]):
        values[lo:hi] = gradient[lo:hi].sum() / (weight[lo:hi].sum() + SHRINK)
    return values


def _quadrants(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree that cuts a table once along each side: its gain and the value of each cell."""
    g, w = gradient.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)
    best, place = 0.0, None
    for i in range(g.shape[0] - 1):
        for j in range(g.shape[1] - 1):
            parts = _parts(g, i, j), _parts(w, i, j)
            gain = sum(a * a / (b + SHRINK) for a, b in zip(*parts) if b > 0)
            if gain > best:
                best, place = gain, (i, j, [a / (b + SHRINK) for a, b in zip(*parts)])
    values = np.zeros(gradient.shape)
    if place:
        i, j, (a, b, c, d) = place
        values[: i + 1, : j + 1], values[: i + 1, j + 1 :] = a, b
        values[i + 1 :, : j + 1], values[i + 1 :, j + 1 :] = c, d
    return best, values


def _parts(sums: np.ndarray, i: int, j: int) -> tuple[float, float, float, float]:
    a, left, top, whole = sums[i, j], sums[-1, j], sums[i, -1], sums[-1, -1]
    return a, top - a, left - a, whole - top - left + a


@dataclass
class AdditiveModel:
    """Tables over bins: ``edges`` and ``tables`` per feature, ``pairs`` with their coarser edges and tables."""

    start: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.start)
        for i, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, rows[:, i], side="right")]
        for a, b, edges_a, edges_b, table in self.pairs:
            total += table[
                np.searchsorted(edges_a, rows[:, a], side="right"), np.searchsorted(edges_b, rows[:, b], side="right")
            ]
        return 1 / (1 + np.exp(-total))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def learn(rows: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS) -> AdditiveModel:
    """The model for rows of features with labels 0 and 1. Without rows of both labels it scores all by their share."""
    n = len(rows)
    share = (labels.sum() + 0.5) / (n + 1) if n else 0.5
    model = AdditiveModel(math.log(share / (1 - share)))
    if n == 0 or labels.min() == labels.max():
        return model
    model.edges = [_edges(rows[:, i], BINS) for i in range(rows.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, rows[:, i], side="right") for i, e in enumerate(model.edges)]
    total = np.full(n, model.start)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return labels - p, p * (1 - p)

    for _ in range(rounds):
        for at, table in zip(bins, model.tables):
            gradient, weight = slope()
            step = RATE * _leaves(
                np.bincount(at, gradient, len(table)), np.bincount(at, weight, len(table)), LEAVES
            )
            table += step
            total += step[at]
    coarse = [_edges(rows[:, i], PAIR_BINS) for i in range(rows.shape[1])]
    places = [np.searchsorted(e, rows[:, i], side="right") for i, e in enumerate(coarse)]
    sizes = [len(e) + 1 for e in coarse]

    def table_of(values: np.ndarray, a: int, b: int) -> np.ndarray:
        return np.bincount(places[a] * sizes[b] + places[b], values, sizes[a] * sizes[b]).reshape(sizes[a], sizes[b])

    gradient, weight = slope()
    gains = [
        (-_quadrants(table_of(gradient, a, b), table_of(weight, a, b))[0], a, b)
        for a, b in combinations(range(rows.shape[1]), 2)
    ]
    chosen = [(a, b) for gain, a, b in sorted(gains)[:pairs] if gain < 0]
    model.pairs = [(a, b, coarse[a], coarse[b], np.zeros((sizes[a], sizes[b]))) for a, b in chosen]
    for _ in range(rounds // 2):
        for a, b, _, _, table in model.pairs:
            gradient, weight = slope()
            step = RATE * _quadrants(table_of(gradient, a, b), table_of(weight, a, b))[1]
            table += step
            total += step[places[a], places[b]]
    return model


def held_out() -> Column:
    """Whether the row's doc_id belongs to the fold whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT_FOLD, F.lit(False))


def _feature_rows(texts: pa.Array) -> np.ndarray:
    rows = [np.array([features(t or "") for t in part], float) for part in text_lists(texts)]
    return np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> AdditiveModel:
    """Learn from ``docs (doc_id, text)`` and ``labels (doc_id, quality)``, labels of the held-out fold left out.

    Rows with a null id or label are not used; of labels that repeat an id the smallest counts.
    """
    few = first_hashes(F.xxhash64("doc_id"), fit_rows, labels.count(), 8)
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out() & few)
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).collect()
    )
    chosen = small_frame(docs.sparkSession, [(r["doc_id"], r["quality"]) for r in chosen], "doc_id long, quality int")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _feature_rows(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), pa.array(rows.tolist(), pa.list_(pa.float64()))],
                names=["doc_id", "quality", "x"],
            )

    known = (
        for_python(docs).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
        .mapInArrow(read, "doc_id long, quality int, x array<double>").collect()
    )
    # The same model from the same rows, whatever order they come in.
    known = sorted(known, key=lambda r: (r["doc_id"], r["quality"], r["x"]))
    return learn(
        np.array([r["x"] for r in known], float).reshape(len(known), len(FEATURES)),
        np.array([r["quality"] for r in known], float),
    )


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; ``predicted`` is 1 from a score of 0.5.

    Null texts are scored as empty ones. A null doc_id is not held out. Repeated rows get their score each; an empty
    table gives an empty result. Without usable labels all score 0.5. Other columns are not read.
    """
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = fit(read, labels, fit_rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.score(_feature_rows(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(found), pa.array((found >= 0.5).astype("int32"))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return for_python(read).select("doc_id", held_out().alias("held_out"), "text").mapInArrow(
        score, "doc_id long, held_out boolean, score double, predicted int"
    )


def without_rejected(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, whose text the model does not reject."""
    model = fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, fit_rows)

    # Of a row only its text goes to Python; the rest waits in the executor.
    @F.arrow_udf("boolean")
    def accepted(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(_feature_rows(texts)) >= 0.5)

    return for_python(docs).where(accepted("text"))
