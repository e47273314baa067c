"""Counts, modes, medians, TF-IDF and clusters on small hand-made tables."""

import math
import random
import re
import statistics

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from caseloom.functions.dates import is_bad_date, parsed
from caseloom.operators import clustering, metrics, scans, tfidf
from caseloom.plans import registry, reports
from caseloom.sources.schema import as_tickets


def make(spark, rows, schema):
    return as_tickets(spark.createDataFrame(rows, schema))


DATES = {
    "": (None, False),
    "2024-13-01": (None, True),
    "2024-03-01 10:00:00": ("2024-03-01 10:00:00", False),
    None: (None, False),
    "soon": (None, True),
    "2024-02-29": ("2024-02-29 00:00:00", False),
    "3/1/2024 9:05": ("2024-03-01 09:05:00", False),
    "12/31/2024": ("2024-12-31 00:00:00", False),
    "31/12/2024": ("2024-12-31 00:00:00", False),
    "31/31/2024": (None, True),
    "3/1/2024 9:05 PM": ("2024-03-01 21:05:00", False),
    "1-Mar-2024": ("2024-03-01 00:00:00", False),
    "Mar 1, 2024": ("2024-03-01 00:00:00", False),
    "March 1, 2024 10:00": ("2024-03-01 10:00:00", False),
    "1 Mar 2024": ("2024-03-01 00:00:00", False),
    "2024/03/01": ("2024-03-01 00:00:00", False),
    "01.03.2024": ("2024-03-01 00:00:00", False),
    "20240301": ("2024-03-01 00:00:00", False),
    "  ": (None, False),
}


def test_dates(spark):
    df = spark.createDataFrame([(x,) for x in DATES], "x string").coalesce(1)
    read = df.withColumn("d", parsed(F.col("x")))
    got = read.select("x", F.col("d").cast("string"), is_bad_date(F.col("x"), F.col("d")).alias("b")).collect()
    assert {r["x"]: (r["d"], r["b"]) for r in got} == DATES


def test_resolution_metrics(spark):
    rows = [
        ("a", "2024-01-31 00:00:00", "2024-01-31 01:00:00"), ("a", "2024-02-01", "2024-02-01 04:00:00"),
        ("a", "2024-02-28", ""), ("a", "2024-01-02", "not yet"), ("b", "2024-05-05", None), ("c", "?", "2024-01-01"),
    ]
    df = make(spark, rows, "category string, date_submitted string, resolution_date string")
    got = {r["category"]: r for r in metrics.resolution_metrics(df, ["category"]).collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a["size"], a["avg_hours"], a["median_hours"], a["n_bad_dates"]) == (4, 2.5, 2.5, 1)
    assert str(a["earliest"])[:10] == "2024-01-02" and str(a["latest"])[:10] == "2024-02-28"
    assert a["peak_month"] == "2024-01"  # tied with February
    assert (b["avg_hours"], b["median_hours"], b["peak_month"]) == (None, None, "2024-05")
    assert (c["n_bad_dates"], c["earliest"]) == (1, None)
    rolled = metrics.roll_up(metrics.resolution_metrics(df, ["category"])).first()
    assert tuple(rolled) == (6, 2.5, 3)
    nothing = metrics.roll_up(metrics.resolution_metrics(df.where("category = 'b'"), ["category"])).first()
    assert tuple(nothing) == (1, None, 1)


@pytest.mark.parametrize("span", [5, 10**6, 10**15])
def test_median_is_exact(spark, span):
    pick = random.Random(span)
    rows = [(g, pick.randint(-span, span)) for g in "xyz" for _ in range(pick.randint(50, 120))]
    rows += [("hot", 7)] * 500 + [("one", -3), (None, 4), (None, 9), ("two", None)]
    df = spark.createDataFrame(rows, "g string, v long")
    got = {r["g"]: r["median"] for r in metrics.exact_median(df, "v", ["g"]).collect()}
    wanted = {}
    for g in {g for g, x in rows if x is not None}:
        wanted[g] = float(statistics.median(x for h, x in rows if h == g and x is not None))
    assert got == pytest.approx(wanted)
    whole = metrics.exact_median(df, "v", []).first()["median"]
    assert whole == pytest.approx(float(statistics.median(x for _, x in rows if x is not None)))


def test_modes_are_values_tied_for_the_top(spark):
    values = ["b", "b", "a", "a", "c"]
    four = ["s", "r", "q", "p"]
    rows = [("two", x) for x in values] + [("four", x) for x in four] + [("null", None), ("blank", "")]
    df = spark.createDataFrame(rows, "g string, category string")
    got = {r["g"]: r["modes"] for r in metrics.tied_modes(df, ["category"], ["g"]).collect()}
    assert got == {"two": ["a", "b"], "four": ["p", "q", "r"], "blank": [""]}


def test_value_counts_and_maps(spark):
    rows = [("g", "x", "m"), ("g", "y", None), ("g", "y", ""), ("g", "z", ""), ("h", None, None)]
    df = spark.createDataFrame(rows, "g string, category string, severity string")
    counts = {(r["field"], r["value"]): r["n"] for r in metrics.value_counts(df, ["category", "severity"]).collect()}
    assert counts == {("category", "x"): 1, ("category", "y"): 2, ("category", "z"): 1, ("severity", "m"): 1, ("severity", ""): 2}
    maps = metrics.value_count_maps(df, ["category", "severity"], ["g"])
    found = maps.select("g", F.map_entries("category").alias("c")).collect()
    assert [(r["g"], [tuple(e) for e in r["c"]]) for r in found] == [("g", [("y", 2), ("x", 1), ("z", 1)])]


def test_samples_and_lists(spark):
    rows = [(f"{i:02d}", i % 4, f"summary {i}") for i in range(12)]
    df = make(spark, rows, "id string, ts long, summary string").withColumn("g", F.lit("g"))
    found = metrics.samples(df, ["g"], "summary", 3, scans.recency()).first()["samples"]
    assert found == ["summary 11", "summary 7", "summary 3"]
    assert [r["id"] for r in scans.latest(df, 4).orderBy(*scans.recency()).collect()] == ["11", "07", "03", "10"]
    paged = scans.recent_candidates(df, 2, 1).orderBy(*scans.recency()).collect()
    assert [r["id"] for r in paged] == ["07", "03"]


def test_filters(spark):
    rows = [
        ("1", 1, "Printer 100% busy", "HIGH", None), ("2", 2, "printer idle", "low", "Severity 2"),
        ("3", 3, "short", "high", ""), ("4", 4, "another one", None, None), ("5", 5, None, "high", "x"),
    ]
    df = make(spark, rows, "id string, ts long, summary string, priority string, severity string")
    ids = lambda found: [r["id"] for r in found.orderBy(*scans.recency()).collect()]
    assert ids(scans.search_substring(df, "PRINTER")) == ["2", "1"]
    assert ids(scans.search_substring(df, "100%")) == ["1"]
    assert ids(scans.search_substring(df, "_")) == []
    assert ids(scans.search_substring(df, "")) == []
    assert ids(scans.search_substring(df, "printer", limit=2)) == ["2"]
    assert ids(scans.high_priority(df)) == ["2", "1"]
    assert scans.full_scan(df).count() == 4
    numbered = df.withColumn("ticket_number", F.lit("same"))
    assert ids(scans.ticket(numbered, "same")) == ["4"]


def plain_tfidf(texts, min_df, max_df, max_features):
    docs = []
    for said in texts:
        words = re.findall(r"\w\w+", said.lower())
        docs.append(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
    vocabulary = {w for d in docs for w in d}
    df = {w: sum(w in d for d in docs) for w in vocabulary}
    total = {w: sum(d.count(w) for d in docs) for w in vocabulary}
    kept = [w for w in vocabulary if min_df <= df[w] <= max_df * len(docs)]
    kept = sorted(kept, key=lambda w: (-total[w], w))[:max_features]  # all where it is None
    weights = {}
    for i, d in enumerate(docs):
        raw = {w: d.count(w) * (math.log((1 + len(docs)) / (1 + df[w])) + 1) for w in kept if w in d}
        size = math.sqrt(sum(x * x for x in raw.values()))
        weights.update({(str(i), w): x / size for w, x in raw.items()})
    return weights


TEXTS = [
    "vpn down again vpn", "vpn slow", "printer down", "printer jam printer jam", "mail slow again", "x",
    "vpn down", "mail lost", "printer down again", "",
]


@pytest.mark.parametrize("features", [4, 2000, None])
def test_tfidf_equals_plain_python(spark, features):
    df = spark.createDataFrame([(str(i), x) for i, x in enumerate(TEXTS)], "id string, text string")
    got = {(r["id"], r["term"]): r["weight"] for r in tfidf.weights(df, "text", [], features, 2, 0.4).collect()}
    assert got == pytest.approx(plain_tfidf(TEXTS, 2, 0.4, features))


@pytest.mark.parametrize("tokens", [1, 4, 500_000])
def test_all_terms_are_weighed_by_pieces(spark, monkeypatch, tokens):
    """Weights of many pieces and buckets are those of one, and the only rows shuffled are pieces and their buckets."""
    monkeypatch.setattr(tfidf, "PIECE_TOKENS", tokens)
    texts = [*TEXTS, None, "the vpn " * 50]
    df = spark.createDataFrame([(str(i), x, i % 2) for i, x in enumerate(texts)], "id string, text string, g int")
    weighted = tfidf.weights(df, "text", ["the"], None, 2, 0.4, keep=["id", "g"])
    got = {(r["id"], r["term"]): r["weight"] for r in weighted.collect()}
    assert got == pytest.approx(plain_tfidf([(x or "").replace("the ", "") for x in texts], 2, 0.4, None))
    assert {(r["id"], r["g"]) for r in weighted.collect()} <= {(str(i), i % 2) for i in range(len(texts))}
    plan = weighted._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"Exchange hashpartitioning\((\w+)#", plan)) == {"_piece", "bucket"}
    twice = df.unionByName(df)
    again = tfidf.weights(twice, "text", ["the"], None, 2, 0.4, keep=["id"])
    assert again.count() == 2 * again.distinct().count() > 0
    assert tfidf.weights(df.limit(0), "text", [], None).count() == 0


def test_terms_are_counted_without_shuffling_them(spark):
    df = spark.createDataFrame([(str(i), x) for i, x in enumerate(TEXTS)], "id string, text string")
    weighted = tfidf.weights(df, "text", [], min_df=2, max_df=0.9)
    assert weighted.count() > 0
    assert "Exchange hashpartitioning" not in weighted._jdf.queryExecution().executedPlan().toString()
    assert tfidf.weights(df.limit(0), "text", []).count() == 0


def test_vectors_hold_the_weights(spark):
    df = spark.createDataFrame([(str(i), x) for i, x in enumerate(TEXTS)], "id string, text string")
    features, names = clustering.text_features(df, "text", [], 2000, 2, 0.4)
    got = {}
    for row in features.collect():
        vector = row["features"]
        got.update({(row["id"], names[i]): x for i, x in zip(vector.indices, vector.values)})
    assert got == pytest.approx(plain_tfidf(TEXTS, 2, 0.4, 2000))
    with pytest.raises(ValueError):
        clustering.text_features(df, "text", [], 2000, 50)


def test_projection_is_pca(spark):
    df = spark.createDataFrame([(str(i), x) for i, x in enumerate(TEXTS)], "id string, text string")
    features, _ = clustering.text_features(df, "text", [], 2000, 2, 0.9)
    placed = features.join(clustering.project_2d(features), "id").collect()
    x = np.array([r["features"].toArray() for r in placed])
    x = x - x.mean(axis=0)
    at = np.array([[r["x"], r["y"]] for r in placed])
    assert at.mean(axis=0) == pytest.approx([0, 0], abs=1e-9)
    singular = np.linalg.svd(x, compute_uv=False)[:2]
    assert np.sqrt((at**2).sum(axis=0)) == pytest.approx(singular)
    axes, _ = clustering.principal_axes(features)
    for axis in axes.T:
        assert axis[np.abs(axis).argmax()] > 0


def test_kmeans_keeps_the_best_run(spark):
    df = spark.createDataFrame([(str(i), x) for i, x in enumerate(TEXTS * 4)], "id string, text string")
    features, _ = clustering.text_features(df, "text", [], 2000, 2, 0.9)
    one = clustering.kmeans(features, k=3, restarts=1)
    best = clustering.kmeans(features, k=3, restarts=6)
    assert best.summary.trainingCost <= one.summary.trainingCost + 1e-9
    labels = clustering.labelled(features, best).select("id", "cluster")
    assert labels.count() == 40 and labels.select("id").distinct().count() == 40
    assert {r["cluster"] for r in labels.collect()} <= {0, 1, 2}


def test_labels_are_the_nearest_centres_whatever_form_vectors_have(spark):
    """Sparse and full vectors in one batch; of equal centres the first; found by matrix products, not value by value."""
    pick = np.random.default_rng(3)
    x = pick.random((60, 7)) * (pick.random((60, 7)) < 0.4)
    rows = [(i, Vectors.dense(v) if i % 3 else Vectors.sparse(7, list(np.flatnonzero(v)), v[v != 0])) for i, v in enumerate(x)]
    features = spark.createDataFrame(rows, ["id", "features"]).coalesce(1)
    centres = np.concatenate([pick.random((3, 7)), np.zeros((1, 7))])
    centres = np.concatenate([centres, centres])
    found = clustering.labelled(features, clustering.Clusters(centres, 0.0))
    wanted = ((x[:, None, :] - centres[:4]) ** 2).sum(axis=2).argmin(axis=1)
    assert [r["cluster"] for r in found.orderBy("id").collect()] == wanted.tolist()
    assert "ArrowEvalPython" in found._jdf.queryExecution().executedPlan().toString()


def test_assign_ties_go_to_the_lower_label(spark):
    points = spark.createDataFrame([("m", [0.0, 0.0]), ("r", [2.0, 0.0])], "id string, v array<float>")
    centroids = spark.createDataFrame([(9, [1.0, 0.0]), (3, [-1.0, 0.0])], "label int, centroid array<double>")
    got = {r["id"]: (r["cluster"], r["distance"]) for r in clustering.assign(points, "v", centroids, "label").collect()}
    assert got == {"m": (3, 1.0), "r": (9, 1.0)}


@pytest.mark.parametrize("batch", [False, True])
def test_root_cause_report(spark, folder, batch):
    tickets = registry.tickets(spark, folder)
    tables = reports.root_cause_patterns(tickets, k=3, restarts=2, max_features=200, batch=batch)
    clusters = tables["clusters"].collect()
    assert sum(r["size"] for r in clusters) == tickets.count() == tables["labels"].count()
    assert all(0 < len(r["keywords"]) <= 7 and len(r["samples"]) <= 5 for r in clusters)
    assert all(sum(r["category"].values()) == r["size"] for r in clusters)
    assert tables["summary"].first()["groups"] == len(clusters)
    placed = tables["projection2d"].collect()
    assert len(placed) == tickets.count()
    assert sum(r["x"] for r in placed) == pytest.approx(0, abs=1e-6)
    if batch:
        assert tables["cluster_prompts"].count() == len(clusters)
        assert tables["cluster_modes"].where(F.size("modes").between(1, 3)).count() == 6 * len(clusters)
        total = tables["overview_counts"].where("field = 'status'").agg(F.sum("n")).first()[0]
        assert total == tickets.count()
