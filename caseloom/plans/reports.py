"""Whole reports put together from the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.fixed_values import (
    BATCH_SAMPLES,
    CLUSTER_SAMPLES,
    KMEANS_RESTARTS,
    KMEANS_SEED,
    MAX_FEATURES,
    N_CLUSTERS,
)
from caseloom.functions.text import clean_text, combined_text, default_stop_words
from caseloom.operators.clustering import (
    cluster_keywords,
    kmeans,
    labelled,
    project_2d,
    text_features,
)
from caseloom.operators.metrics import (
    first_of_group,
    listed,
    resolution_metrics,
    roll_up,
    tied_modes,
    value_count_maps,
    value_counts,
)
from caseloom.operators.prompts import batch_prompts, cluster_messages
from caseloom.operators.scans import recency
from caseloom.operators.tfidf import keyword_lists

METADATA = ["category", "task_type", "severity"]
MODE_FIELDS = ["category", "project", "severity", "priority", "status", "task_type"]
OVERVIEW_FIELDS = ["category", "severity", "status"]


NARROW = ["id", "ts", "date_submitted", "resolution_date", *MODE_FIELDS]


def group_report(tickets: DataFrame, keywords: DataFrame, samples: DataFrame) -> DataFrame:
    """One row per ``cluster``: size, keywords, times, value counts and the question to ask about it.

    ``tickets`` carries the group in ``cluster``; ``keywords`` and ``samples`` have one row per group, and
    so has every other part by the time it is joined.
    """
    report = resolution_metrics(tickets, ["cluster"])
    for part in (value_count_maps(tickets, METADATA, ["cluster"]), samples, keywords):
        report = report.join(part, "cluster", "left")
    return report.withColumn("messages", cluster_messages())


def with_text(tickets: DataFrame, batch: bool = False, stop_words: Sequence[str] = ()) -> DataFrame:
    """Add the text tickets are clustered by; the batch form has the owner in it and is cleaned."""
    text = combined_text(with_owner=batch)
    return tickets.withColumn("combined_text", text).withColumn(
        "cluster_text", clean_text(F.col("combined_text"), stop_words) if batch else F.col("combined_text")
    )


def root_cause_patterns(
    tickets: DataFrame,
    k: int = N_CLUSTERS,
    restarts: int = KMEANS_RESTARTS,
    seed: int = KMEANS_SEED,
    max_features: int = MAX_FEATURES,
    stop_words: Sequence[str] | None = None,
    batch: bool = False,
    cleaning_stop_words: Sequence[str] | None = None,
    order: list[Column] | None = None,
    projection: bool = True,
) -> dict[str, DataFrame]:
    """Cluster tickets by their text and describe the clusters; the tables of the report by name.

    ``batch`` is the form of the offline report: cleaned text with the owner, value counts of the whole
    table, tied modes and its own two questions per cluster. ``cleaning_stop_words`` are dropped from its
    texts first, ``stop_words`` from the terms of either form.

    Texts are read twice, for the vocabulary and for the vectors. All else is computed from the vectors and
    the few narrow columns checkpointed with them, without a join; only the sample texts are fetched again.
    """
    stop_words = default_stop_words() if stop_words is None else stop_words
    cleaning = stop_words if cleaning_stop_words is None else cleaning_stop_words
    order = order or recency()
    source = tickets if batch else tickets.where(F.col("summary").isNotNull())
    docs = with_text(source, batch, cleaning)
    features, names = text_features(docs, "cluster_text", stop_words, max_features, keep=NARROW)
    grouped = labelled(features, kmeans(features, k, restarts, seed))
    keywords = cluster_keywords(grouped, names)

    def sample_texts(n: int) -> DataFrame:
        # No more than n rows for each of the k clusters.
        chosen = F.broadcast(first_of_group(grouped, ["cluster"], n, order).select("cluster", "_at", "id"))
        return listed(docs.select("id", "combined_text").join(chosen, "id"), ["cluster"], "combined_text")

    clusters = group_report(grouped, keyword_lists(keywords, "cluster"), sample_texts(CLUSTER_SAMPLES))
    tables = {
        "labels": grouped.select("id", "cluster"),
        "clusters": clusters,
        "summary": roll_up(resolution_metrics(grouped, ["cluster"])),
        "cluster_counts": value_counts(grouped, METADATA, ["cluster"]),
        "cluster_keywords": keywords,
    }
    if projection:
        tables["projection2d"] = project_2d(grouped, ["id", "cluster"])
    if batch:
        tables["overview_counts"] = value_counts(features, OVERVIEW_FIELDS)
        tables["cluster_modes"] = tied_modes(grouped, MODE_FIELDS, ["cluster"])
        tables["cluster_prompts"] = batch_prompts(sample_texts(BATCH_SAMPLES), "cluster")
    return tables
