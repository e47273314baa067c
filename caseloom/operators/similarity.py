"""Similar tickets, recommended resolutions and retrieval context."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.fixed_values import (
    CONTEXT_FALLBACK_RECENT,
    CONTEXT_FALLBACK_THRESHOLD,
    CONTEXT_K,
    CONTEXT_THRESHOLD,
    NO_RESOLUTION,
    NOT_AVAILABLE,
    RECOMMEND_K,
    RECOMMEND_THRESHOLD,
    SIMILAR_K,
    SIMILAR_THRESHOLD,
)
from caseloom.functions.text import non_blank, resolution
from caseloom.operators.scans import recent
from caseloom.operators.scoring import (
    BLOCK_ROWS,
    BY_RECENCY,
    CELL_ROWS,
    Found,
    Rule,
    top_k,
    top_k_of_block,
    top_k_or_recent_of_block,
)
from caseloom.sources.schema import CANDIDATE_COLUMNS


@dataclass
class Candidates:
    """The tickets a search looks at: all searchable ones, or the newest ``limit``.

    With a limit they are fetched once, at most ``limit`` rows, and serve any number of searches.
    Without one they stay a distributed table.
    """

    tickets: DataFrame
    newest: pa.Table | None = None

    @classmethod
    def of(cls, tickets: DataFrame, limit: int | None = None) -> Candidates:
        found = recent(tickets.select(*CANDIDATE_COLUMNS, "embedding"), limit)
        if limit is None or limit > BLOCK_ROWS:
            return cls(found)
        table = found.toArrow().sort_by([("ts", "descending"), ("id", "descending")])
        local = tickets.sparkSession.createDataFrame(table, found.schema)
        return cls(local, table)

    def first(self, n: int | None) -> Candidates:
        """The newest ``n`` of them, or all."""
        if n is None:
            return self
        if self.newest is None:
            return Candidates.of(self.tickets, n)
        table = self.newest.slice(0, n)
        return Candidates(self.tickets.sparkSession.createDataFrame(table, self.tickets.schema), table)

    def scored(
        self, queries: DataFrame, rule: Rule, block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS
    ) -> Found:
        """Best hits per query."""
        usable = _usable(self.tickets)
        if self.newest is None:
            return top_k(queries, usable, rule, block_rows, cell_rows)
        return Found(top_k_of_block(queries, usable.toArrow(), usable.schema, rule), False)

    def scored_or_recent(self, queries: DataFrame, strict: Rule, loose: Rule, recent: int | None) -> DataFrame:
        """Best hits per query among tickets fetched already; see ``top_k_or_recent_of_block``."""
        usable = _usable(self.tickets)
        # Tickets that cannot be scored count among the newest all the same.
        scored_recent = _usable(self.first(recent).tickets).where(F.size("embedding") > 0).count()
        return top_k_or_recent_of_block(
            queries, usable.toArrow(), usable.schema, strict, loose, scored_recent
        )

    def described(self, hits: DataFrame, few: bool) -> DataFrame:
        """Hits with the columns of their tickets.

        Tickets fetched already, no more than the limit, are sent to the hits. Few hits, k per query of a
        block of bounded size, are sent to the tickets. With many of both the join is Spark's choice.
        """
        hits, tickets = hits.drop("ts"), self.tickets.drop("embedding")
        if self.newest is not None:
            return hits.join(F.broadcast(tickets), "id")
        return (F.broadcast(hits) if few else hits).join(tickets, "id")


def _usable(tickets: DataFrame) -> DataFrame:
    return tickets.where(non_blank(F.col("summary")))


def hits(
    candidates: Candidates, queries: DataFrame, threshold: float, k: int, exclude_self: bool = False
) -> DataFrame:
    return candidates.described(*candidates.scored(queries, Rule(threshold, k, exclude_self=exclude_self)))


def similar(
    candidates: Candidates,
    queries: DataFrame,
    threshold: float = SIMILAR_THRESHOLD,
    k: int = SIMILAR_K,
    exclude_self: bool = False,
) -> DataFrame:
    """The ``k`` most similar tickets per query (``query_id, query_vec``) with their columns."""
    return hits(candidates, queries, threshold, k, exclude_self).select(
        "query_id", "rank", "ticket_number", "summary", "project", "category", "severity", "priority",
        "status", "resolution_date", "latest_comments", "id", F.col("score").alias("similarity_score"),
    )


def recommend(
    candidates: Candidates,
    queries: DataFrame,
    threshold: float = RECOMMEND_THRESHOLD,
    k: int = RECOMMEND_K,
    exclude_self: bool = False,
) -> DataFrame:
    """The ``k`` most similar tickets per query with what resolved them."""
    return hits(candidates, queries, threshold, k, exclude_self).select(
        "query_id",
        "rank",
        F.struct("ticket_number", "summary", "project", "category", "id").alias("ticket_info"),
        resolution(F.col("latest_comments"), NO_RESOLUTION).alias("probable_resolution"),
        F.col("score").alias("similarity_score"),
    )


def context(
    candidates: Candidates,
    queries: DataFrame,
    threshold: float = CONTEXT_THRESHOLD,
    k: int = CONTEXT_K,
    fallback_threshold: float = CONTEXT_FALLBACK_THRESHOLD,
    fallback_recent: int | None = CONTEXT_FALLBACK_RECENT,
    exclude_self: bool = False,
    summary_chars: int | None = None,
    resolution_chars: int | None = None,
) -> DataFrame:
    """Past tickets to answer a query with: the ``k`` best above the threshold.

    A query with none takes the first ``k`` of the newest ``fallback_recent`` tickets (``None``: of all) that reach
    the lower threshold, newest first. Either way they are then ranked by score. Texts come whole; ``summary_chars``
    and ``resolution_chars`` cut them for prompts that must be short.
    """
    strict = Rule(threshold, k, exclude_self=exclude_self)
    loose = Rule(fallback_threshold, k, BY_RECENCY, exclude_self)
    if candidates.newest is not None:
        chosen, few = candidates.scored_or_recent(queries, strict, loose, fallback_recent), False
    else:
        chosen, few = _best_or_recent(candidates, queries, strict, loose, fallback_recent)
    return candidates.described(chosen, few).select(
        "query_id", "rank", "is_fallback", "id",
        F.coalesce("ticket_number", F.lit(NOT_AVAILABLE)).alias("ticket"),
        _cut(F.col("summary"), summary_chars).alias("summary"),
        _cut(F.coalesce("latest_comments", F.lit(NOT_AVAILABLE)), resolution_chars).alias("resolution"),
        F.coalesce("category", F.lit(NOT_AVAILABLE)).alias("category"),
        F.col("score").alias("similarity"),
    )


def _cut(text: Column, chars: int | None) -> Column:
    return text if chars is None else F.substring(text, 1, chars)


def _best_or_recent(
    candidates: Candidates, queries: DataFrame, strict: Rule, loose: Rule, recent: int | None
) -> tuple[DataFrame, bool]:
    """Both searches for all queries, then per query the strict hits if there are any."""
    best = candidates.scored(queries, strict)
    newest = candidates.first(recent).scored(queries, loose)
    # At most 2k rows per query meet here.
    per_query = Window.partitionBy("query_id")
    by_score = per_query.orderBy(F.desc("score"), F.desc("ts"), F.desc("id"))
    chosen = (
        best.hits.withColumn("is_fallback", F.lit(False))
        .unionByName(newest.hits.withColumn("is_fallback", F.lit(True)))
        .withColumn("_strict_found", F.bool_or(~F.col("is_fallback")).over(per_query))
        .where(F.col("is_fallback") != F.col("_strict_found"))
        .withColumn("rank", F.row_number().over(by_score))
        .drop("_strict_found")
    )
    return chosen, best.few
