"""Parts of many queries and many tickets: vectors that rows share, leaves that are left out, buckets that pairs must share."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.functions import text
from caseloom.operators import neighbours, scoring
from caseloom.operators.scoring import BY_RECENCY, Part, Rule, Shared, top_k
from caseloom.plans import registry

KEYS = T.StructType([T.StructField(c, T.LongType()) for c in ("query_id", "id", "ts")])
SCHEMA = scoring.hit_schema(KEYS, KEYS)


def near_groups(n, width=6, seed=3):
    random = np.random.default_rng(seed)
    middles = random.standard_normal((12, width))
    return (middles[random.integers(0, 12, n)] + 0.05 * random.standard_normal((n, width))).astype(np.float32)


def shared(vectors, columns, copies=None):
    copies = np.ones(len(vectors), np.int32) if copies is None else copies
    return Shared([pa.array(c, pa.int64()) for c in columns], copies, vectors)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("exclude_self", [False, True])
@pytest.mark.parametrize("by", ["score", BY_RECENCY])
def test_part_equals_brute_force(monkeypatch, by, exclude_self):
    monkeypatch.setattr(scoring, "LEAF_ROWS", 16)
    x = near_groups(600)
    x[5], x[6], x[7], x[8:20] = 0, np.nan, np.inf, x[3]
    n, k, threshold = len(x), 4, 0.2
    ts = np.arange(n) // 3
    with np.errstate(all="ignore"):
        order = scoring._together(x)
        part = Part([shared(x[o], [o, ts[o]]) for o in np.array_split(order, 3)], Rule(threshold, k, by, exclude_self), None)
        got = part.hits(shared(x[order], [order]), SCHEMA).to_pylist()
        unit = scoring.unit_matrix(x.astype(np.float64))
        scores = np.round(unit @ unit.T, 9)
    found = {}
    for row in got:
        found.setdefault(row["query_id"], []).append(row)
    for q in range(n):
        reached = [i for i in range(n) if scores[q, i] >= threshold and not (exclude_self and i == q)]
        reached.sort(key=lambda i: (ts[i], i) if by == BY_RECENCY else (scores[q, i], ts[i], i), reverse=True)
        rows = sorted(found.get(q, []), key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(reached[:k]) + 1))
        assert np.allclose([r["score"] for r in rows], [scores[q, i] for i in reached[:k]], atol=2e-9)
        if by == BY_RECENCY or 3 <= q < 20:
            assert [r["id"] for r in rows] == reached[:k]


def test_bound_of_a_leaf_is_never_too_low_and_leaves_are_left_out(monkeypatch):
    monkeypatch.setattr(scoring, "LEAF_ROWS", 16)
    for width in (3, 6, 26):
        x = near_groups(800, width)
        x = x[scoring._together(x)]
        part = Part([shared(x, [np.arange(800), np.arange(800)])], Rule(0.3, 5), None)
        unit = scoring.unit_matrix(x.astype(np.float64))
        scores, bound = unit @ unit.T, part._bound(unit)
        assert bound.shape == (50, 800)
        assert (np.maximum.reduceat(scores, part.begins, axis=0) <= bound + scoring.BOX_SLACK).all()
        assert (bound >= 0.95).mean() < 0.5


def test_rows_share_their_vector(spark):
    rows = [(f"t{i:03d}", i, [float(i % 5 + 1), 1.0]) for i in range(200)]
    tickets = spark.createDataFrame(rows, "id string, ts long, embedding array<float>")
    every = scoring.blocks(tickets, ["id", "ts"], "embedding", 64)
    newest = scoring.blocks(tickets, ["id", "ts"], "embedding", 64, 3)
    size = lambda b: b.agg(F.sum(F.size("id")), F.sum(F.length("matrix")), F.max(F.size("id"))).first()
    assert tuple(size(every))[:2] == (200, 5 * 2 * 4)
    assert tuple(size(newest))[:2] == (15, 5 * 2 * 4)
    kept = newest.select(F.explode("ts").alias("ts")).agg(F.min("ts")).first()[0]
    assert kept == 185


def test_blocks_go_to_python_once(spark):
    rows = [(f"{i}", i, [float((i * k) % 97 + 1) for k in range(1, 9)]) for i in range(600)]
    tickets = spark.createDataFrame(rows, "id string, ts long, embedding array<float>")
    queries = tickets.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"))
    found = top_k(queries, tickets, Rule(0.9, 3), 0, 16).hits
    met = next(line for line in plan_of(found).splitlines() if "CartesianProduct" in line)
    assert "asking_place" in met and " OR " in met
    assert found.count() == 1800


def vectors(spark, n=300, dim=8):
    x = np.random.default_rng(4).standard_normal((n, dim))
    rows = [(f"t{i:04d}", i, "a summary", v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id string, ts long, summary string, embedding array<float>")


@pytest.mark.parametrize("probes", [0, 2])
def test_buckets_are_the_same_whether_copies_are_dealt_or_not(spark, monkeypatch, probes):
    def likely():
        return neighbours.likely_similar_for_all(vectors(spark), 8, 0.3, 4, bands=2, bits=4, probes=probes, cell_rows=40)

    stored = likely()
    assert "CoGroup" not in plan_of(stored)
    monkeypatch.setattr(neighbours, "DENSE", 1e9)
    dealt = likely()
    assert "CoGroup" in plan_of(dealt)
    rows = [sorted((r["query_id"], r["id"], r["rank"], round(r["score"], 6)) for r in df.collect()) for df in (stored, dealt)]
    assert rows[0] and rows[0] == rows[1]


def test_ids_that_come_again_are_hits_once(spark):
    twice = vectors(spark, 60).unionByName(vectors(spark, 60))
    found = neighbours.likely_similar_for_all(twice, 8, 0.1, 4, bands=2, bits=4, probes=1)
    hits = found.select("query_id", "id").groupBy("query_id", "id").count()
    assert "CoGroup" in plan_of(found)
    # Every query is there twice, and either has a hit once.
    assert {r["count"] for r in hits.collect()} == {2}


def test_hits_are_repeated_for_hot_vectors_only(spark):
    found = neighbours.similar_for_all(vectors(spark, 60), 0.1, 4)
    assert "_hot" in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.select("query_id").distinct().count() == 60


@pytest.mark.parametrize("step", [1, 7, 1 << 18])
def test_letters_are_counted_in_one_pass(spark, monkeypatch, step):
    monkeypatch.setattr(text, "COUNTED_BYTES", step)
    said = ["", None, "  ", "A zebra, ÄÖ µ ß z", "q" * 30, "\nx", "İI"]
    docs = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, said string").coalesce(1)
    embedded = registry.by_letters(docs, "said")
    assert "ArrowEvalPython" in plan_of(embedded)
    got = {r["i"]: r["embedding"] for r in embedded.collect()}
    for i, s in enumerate(said):
        blank = s is None or not s.strip()
        assert got[i] == (None if blank else [float(s.lower().count(c)) for c in registry.LETTERS])
