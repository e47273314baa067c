"""Forms that hold at scale: the laid-out index, k-means and components in few passes, blocks of centroids, whole vocabularies,
published reports, kept embeddings, expiring state."""

import datetime
import math
import os
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from caseloom.operators import clustering, memo, metrics, neighbours, tfidf
from caseloom.operators.similarity import Candidates
from caseloom.plans import searches
from caseloom.sources import sinks
from caseloom.sources.schema import as_tickets
from caseloom.streaming import expiry
from caseloom.streaming.messages import write_changes


# --- index by sign bits ---

def near_and_far(seed, n, dim):
    """Vectors with neighbours at all cosines."""
    picked = np.random.default_rng(seed)
    base = picked.standard_normal((n // 4, dim))
    parts = [base, *(base + spread * picked.standard_normal(base.shape) for spread in (0.7, 1.3, 2.2))]
    return np.concatenate(parts)


@pytest.mark.parametrize("threshold", [0.3, 0.4, 0.6, 0.8])
def test_index_finds_what_it_promises(spark, threshold):
    x = near_and_far(1, 1200, 48)
    rows = [(f"t{i:04d}", i, "a summary", v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id string, ts long, summary string, embedding array<float>")
    exact = {(r["query_id"], r["id"]) for r in neighbours.similar_for_all(df, threshold, 50).collect()}
    likely = neighbours.likely_similar_for_all(df, 48, threshold, 50, bits=5)
    found = {(r["query_id"], r["id"]) for r in likely.collect()}
    recall = len(found & exact) / len(exact)
    print(f"recall at {threshold}: {recall:.3f} of {len(exact)}")
    assert found <= exact and recall >= 0.9


def test_chances_are_those_of_random_planes():
    picked = np.random.default_rng(5)
    for threshold, bits in ((0.4, 6), (0.8, 12)):
        x, y = picked.standard_normal((2, 20_000, bits))
        y = threshold * x + math.sqrt(1 - threshold**2) * y
        off = (x >= 0) != (y >= 0)
        nearest = np.argsort(np.abs(x), axis=1)
        chances = neighbours.chances(bits, threshold)
        for k in (0, 1, 3):
            one = (off.sum(axis=1) == 1) & np.take_along_axis(off, nearest[:, :k], axis=1).any(axis=1)
            assert chances[k] == pytest.approx((~off.any(axis=1) | one).mean(), abs=0.02)


def test_index_is_laid_out_for_the_rows():
    assert neighbours.Index.of(500, 0.4).bits == 0  # exact where it is as cheap
    assert neighbours.Index.of(10**5, 0.9).bits < neighbours.Index.of(10**7, 0.9).bits
    index = neighbours.Index.of(10**6, 0.8, 0.95, bits=10, probes=2)
    met = neighbours.chances(10, 0.8)[2]
    assert (index.bits, index.probes) == (10, 2) and 1 - (1 - met) ** index.bands >= 0.95


# --- k-means, components, centroids ---

def vectors_of(spark, x):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<double>")
    return df.select("id", array_to_vector("v").alias("features"))


def lloyd(x, centres, steps):
    for _ in range(steps):
        label = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.array([x[label == k].mean(0) if (label == k).any() else c for k, c in enumerate(centres)])
    return centres


def test_all_runs_take_their_steps_together(spark):
    picked = np.random.default_rng(2)
    x = np.concatenate([picked.standard_normal((80, 5)) + 4 * picked.standard_normal(5) for _ in range(4)])
    features = vectors_of(spark, x)
    starts = [x[picked.choice(len(x), 4, replace=False)] for _ in range(3)]
    costs = []
    for start in starts:
        one = clustering.kmeans(features, start=[start], max_iter=4, tolerance=-1.0)
        assert one.centres == pytest.approx(lloyd(x, start, 4))
        costs.append(one.trainingCost)
        nearest = ((x[:, None] - one.centres[None]) ** 2).sum(2).min(1).sum()
        assert one.trainingCost == pytest.approx(nearest)
    together = clustering.kmeans(features, start=starts, max_iter=4, tolerance=-1.0)
    assert together.trainingCost == pytest.approx(min(costs))
    best = clustering.kmeans(features, k=4, restarts=8, tolerance=1e-9)
    assert best.centres == pytest.approx(lloyd(x, best.centres, 1))  # settled
    labels = {r["id"]: r["cluster"] for r in clustering.labelled(features, best).collect()}
    wanted = ((x[:, None] - best.centres[None]) ** 2).sum(2).argmin(1)
    assert [labels[i] for i in range(len(x))] == wanted.tolist()


def test_kmeans_with_fewer_points_than_clusters(spark):
    found = clustering.kmeans(vectors_of(spark, np.array([[1.0, 0.0]] * 5 + [[0.0, 2.0]])), k=4, restarts=2)
    assert sorted(found.centres.tolist()) == [[0.0, 2.0], [1.0, 0.0]] and found.trainingCost == pytest.approx(0)


@pytest.mark.parametrize("rows, size", [(400, 120), (50, 90), (300, 6)])
def test_components_are_those_of_the_whole_matrix(spark, rows, size):
    picked = np.random.default_rng(size)
    x = picked.standard_normal((rows, size)) * np.linspace(2, 1, size) * (picked.random((rows, size)) < 0.3)
    axes, mean = clustering.principal_axes(vectors_of(spark, x), 2)
    assert mean == pytest.approx(x.mean(0))
    wanted = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:2].T
    assert np.abs((axes * wanted).sum(0)) == pytest.approx([1, 1], abs=1e-6)
    assert all(a[np.abs(a).argmax()] > 0 for a in axes.T)


def test_many_centroids_are_read_in_blocks(spark):
    picked = np.random.default_rng(4)
    centres, x = picked.standard_normal((20_000, 4)), picked.standard_normal((300, 4))
    centroids = spark.createDataFrame(pd.DataFrame({"label": np.arange(20_000), "centroid": centres.tolist()}))
    points = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<double>")
    found = {r["id"]: (r["cluster"], r["distance"]) for r in clustering.assign(points, "v", centroids, "label").collect()}
    distance = np.sqrt(((x[:, None] - centres[None]) ** 2).sum(2))
    assert [found[i][0] for i in range(300)] == distance.argmin(1).tolist()
    assert [found[i][1] for i in range(300)] == pytest.approx(distance.min(1), abs=1e-4)
    none = clustering.assign(points, "v", centroids.limit(0), "label").collect()
    assert {(r["cluster"], r["distance"]) for r in none} == {(None, None)}


# --- terms, medians ---

def test_terms_are_counted_in_their_batch(spark):
    texts = {1: "red red blue red red", 2: "", 3: "one", 4: None, 5: "blue red blue red blue"}
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    split = tfidf.tokenised(df, "text", [], ["id"])
    counts = tfidf.term_counts(split, ["id"])
    wanted = Counter()
    for i, said in texts.items():
        words = (said or "").split()
        wanted.update((i, w) for w in words)
        wanted.update((i, f"{a} {b}") for a, b in zip(words, words[1:]))
    assert {(r["id"], r["term"]): r["tf"] for r in counts.collect()} == dict(wanted)
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_some_tokens_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    lists = [["a", "b", "a"], None, [], ["b"], list("abcabcabc"), ["a", "b"]]
    batch = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.string()))], names=[tfidf.TOKENS])
    parts = list(tfidf._parts(batch, 5))
    assert [p.num_rows for p in parts] == [4, 1, 1] and pa.Table.from_batches(parts).column(0).to_pylist() == lists
    split = spark.createDataFrame([(i, w) for i, w in enumerate(lists)], f"id int, {tfidf.TOKENS} array<string>").coalesce(1)
    whole = sorted(map(tuple, tfidf.term_counts(split, ["id"]).drop("_row").collect()))
    monkeypatch.setattr(tfidf, "TOKENS_AT_ONCE", 5)
    assert sorted(map(tuple, tfidf.term_counts(split, ["id"]).drop("_row").collect())) == whole
    assert (0, "a", 2) in whole and (4, "c a", 2) in whole


def test_approximate_median_is_near_the_middle(spark):
    df = spark.range(50_000).select((F.col("id") % 3).alias("g"), (F.xxhash64("id") % 10**12).alias("v"))
    accuracy = 200
    found = {r["g"]: r["median"] for r in metrics.approximate_median(df, "v", ["g"], accuracy).collect()}
    for g, median in found.items():
        values = sorted(r["v"] for r in df.where(F.col("g") == g).collect())
        rank = values.index(median)
        assert abs(rank - len(values) / 2) <= len(values) / accuracy + 1


# --- reports ---

def test_reports_are_seen_whole_or_not_at_all(spark, tmp_path):
    path, one = str(tmp_path / "r"), spark.range(3)
    assert sinks.published(spark, path) == {}
    first = sinks.publish({"a": one, "b": one.limit(1)}, path)
    broken = one.select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception, match="no"):
        sinks.publish({"a": spark.range(9), "b": broken}, path)
    found = sinks.published(spark, path)
    assert sorted(found) == ["a", "b"] and found["a"].count() == 3  # the half-written version is not seen
    sinks.publish({"a": spark.range(7)}, path)
    assert {k: v.count() for k, v in sinks.published(spark, path).items()} == {"a": 7}
    assert sinks.published(spark, path, first)["b"].count() == 1
    with pytest.raises(ValueError):
        sinks.publish({}, path)


# --- embeddings ---

def counting_model(log):
    """A model that writes down when it is loaded and each text that it is asked for."""

    def load():
        def note(line):
            with open(log, "a") as file:
                file.write(line + "\n")

        def encode(texts):
            for t in texts:
                note("asked " + t)
            return [None if "unknown" in t else [float(len(t)), float(t.count("a")), 1.0] for t in texts]

        note(f"loaded {os.getpid()}")
        return encode

    return load


def test_each_text_is_embedded_once_over_searches(spark, tmp_path):
    load = counting_model(str(tmp_path / "log"))
    embed = memo.EmbeddingMemo(spark, str(tmp_path / "memo"), "lengths", memo.by_model("counting", load))
    texts = ["printer jam"] * 40 + ["vpn a", "banana", " ", None, "an unknown text"]
    tickets = as_tickets(spark.createDataFrame([(str(i), i, t) for i, t in enumerate(texts)], "id string, ts long, summary string"))
    queries = spark.createDataFrame([(1, "printer jam"), (2, "mail a"), (3, "  "), (4, None)], "query_id long, text string")
    answers = []
    for _ in range(2):
        candidates = Candidates.of(embed(tickets, "summary"))
        answers.append(sorted(map(tuple, searches.similar_to(queries, candidates, embed).select("query_id", "rank", "id").collect())))
    assert answers[0] == answers[1] and len(answers[0]) == 10
    log = (tmp_path / "log").read_text().splitlines()
    asked = sorted(x for x in log if x.startswith("asked"))
    assert asked == ["asked an unknown text", "asked banana", "asked mail a", "asked printer jam", "asked vpn a"]
    loads = [x for x in log if x.startswith("loaded")]
    assert len(loads) == len(set(loads))  # once per worker
    found = {r["id"]: r["embedding"] for r in embed(tickets, "summary").collect()}
    assert len(found) == 45 and found["42"] is None and found["43"] is None and found["44"] is None
    assert found["0"] == found["39"] == [11.0, 1.0, 1.0]
    other = memo.EmbeddingMemo(spark, str(tmp_path / "memo"), "another", memo.by_model("counting", load))
    assert other.rows().count() == 0


# --- state that expires ---

def test_state_of_users_who_stay_away_is_dropped(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    batches = [
        [("ann", "r1", 0, "m1"), ("bob", "r2", 1, "m2"), ("ann", "r0", -5, "m0"), (None, "x", 0, "m"), ("cid", "x", None, "m")],
        [("ann", "r3", 30, "m3"), ("bob", "old", 0, "m1")],
        [("dan", "r4", 200, "m4")],
        [("bob", "r5", 210, "m5")],
    ]
    schema = "user string, reference string, ts timestamp, message string"
    for i, rows in enumerate(batches):
        timed = [(u, r, None if m is None else start + datetime.timedelta(minutes=m), n) for u, r, m, n in rows]
        spark.createDataFrame(timed, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        for name in os.listdir(tmp_path / f"in/{i}"):
            if name.startswith("part"):
                os.utime(tmp_path / f"in/{i}/{name}", (1_700_000_000 + i, 1_700_000_000 + i))
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    changes = expiry.latest_per_user_until(arriving, "user", F.col("reference"), F.col("ts"), F.col("message"), 3600)
    before = spark.conf.get(expiry.STATE_STORE[0])
    spark.conf.set(*expiry.STATE_STORE)
    try:
        query = write_changes(changes, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        query.awaitTermination()
    finally:
        spark.conf.set(expiry.STATE_STORE[0], before)
    rows = [
        (r["user"], r["reference"], r["expired"])
        for r in spark.read.parquet(str(tmp_path / "out")).orderBy("batch", "user", "expired").collect()
    ]
    assert rows[:3] == [("ann", "r1", False), ("bob", "r2", False), ("ann", "r3", False)]
    assert set(rows[3:]) == {
        ("dan", "r4", False), ("ann", None, True), ("bob", "r5", False),  # bob came back before his state went
    }
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert held[-1] == 2  # dan and bob


def test_missing_report_is_no_error(spark, tmp_path):
    with pytest.raises(AnalysisException):
        spark.read.parquet(str(tmp_path / "nothing"))
    assert sinks.published(spark, str(tmp_path / "nothing")) == {}
