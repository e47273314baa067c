"""Filters, lists and profiles over the ticket table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.fixed_values import (
    CONTEXT_THRESHOLD,
    LIST_K,
    MIN_SUMMARY_CHARS,
    NO_COMMENTS,
    NOT_AVAILABLE,
    NOT_RESOLVED,
    RECOMMEND_THRESHOLD,
    SIMILAR_THRESHOLD,
)
from caseloom.functions.text import non_blank, or_default, preview
from caseloom.sources.schema import CANDIDATE_COLUMNS, SCAN_COLUMNS

EARLIEST = -(2**63)


def recency() -> list[Column]:
    """Newest first; the id settles ties, so every list has one order."""
    return [F.desc("ts"), F.desc("id")]


def full_scan(tickets: DataFrame) -> DataFrame:
    return tickets.where(F.col("summary").isNotNull()).select(*SCAN_COLUMNS)


def searchable(tickets: DataFrame) -> DataFrame:
    """Tickets whose summary is present and longer than five characters."""
    return tickets.where(F.col("summary").isNotNull() & (F.length("summary") > MIN_SUMMARY_CHARS))


def recent(tickets: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """The searchable tickets of the whole table, in no order; with a ``limit`` the newest ones only.

    With a limit their times are found first, on two narrow columns. Whole rows are then only read from where the
    oldest of these times allows: the filter reaches the scan, and files written in the order of time
    answer it from their statistics. Each task keeps its newest ``limit`` of what is left.
    """
    found = searchable(tickets)
    if limit is None:
        return found
    newest = found.select("ts", "id").orderBy(*recency()).limit(limit + offset)
    oldest = newest.agg(F.min(F.coalesce("ts", F.lit(EARLIEST)))).scalar()
    ordered = found.where((F.col("ts") >= oldest) | F.col("ts").isNull()).orderBy(*recency())
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def recent_candidates(tickets: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    return recent(tickets.select(*CANDIDATE_COLUMNS), limit, offset)


def latest(tickets: DataFrame, n: int = LIST_K) -> DataFrame:
    return recent_candidates(tickets, n)


def search_substring(tickets: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Tickets whose summary contains the query, letter case aside; an empty query finds none.

    The whole table is searched; ``limit`` searches only that many newest tickets.
    """
    wanted = F.lower(F.lit(query))
    return recent_candidates(tickets, limit).where(
        F.contains(F.lower("summary"), wanted) & (wanted != "")
    )


def is_high_priority() -> Column:
    high = F.lower("priority").eqNullSafe(F.lit("high"))
    severe = F.coalesce(F.lower("severity").isin("severity 1", "severity 2"), F.lit(False))
    return high | severe


def high_priority(tickets: DataFrame, n: int = LIST_K, limit: int | None = None) -> DataFrame:
    """The newest tickets of high priority or severity 1 or 2, in the whole table or among the newest ``limit``."""
    found = recent_candidates(tickets, limit).where(is_high_priority())
    return found.orderBy(*recency()).limit(n)


def ticket(tickets: DataFrame, number: str, limit: int | None = None) -> DataFrame:
    """The newest ticket with this number, in the whole table or among the newest ``limit``."""
    found = recent_candidates(tickets, limit).where(F.col("ticket_number").cast("string") == number)
    return found.orderBy(*recency()).limit(1)


def details(tickets: DataFrame) -> DataFrame:
    """What a ticket page shows, with texts in place of missing values."""
    return tickets.select(
        "ticket_number", "status", "priority", "category", "severity", "project", "date_submitted",
        or_default(F.col("resolution_date"), NOT_RESOLVED).alias("resolution_date"),
        or_default(F.col("latest_comments"), NO_COMMENTS).alias("latest_comments"),
    )


def head(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def profile(tickets: DataFrame, now: int, loaded_at: int) -> DataFrame:
    """Counts of a candidate table, its age in seconds and the thresholds in use: one row."""
    return tickets.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(non_blank(F.col("summary"))).alias("with_summary"),
        F.count_if(non_blank(F.col("latest_comments"))).alias("with_comments"),
    ).select(
        "*",
        F.lit(now - loaded_at).alias("age_seconds"),
        F.lit(SIMILAR_THRESHOLD).alias("similar_threshold"),
        F.lit(RECOMMEND_THRESHOLD).alias("recommend_threshold"),
        F.lit(CONTEXT_THRESHOLD).alias("context_threshold"),
    )


def profile_samples(tickets: DataFrame, n: int = 3) -> DataFrame:
    """The newest tickets of a candidate table in short."""
    return head(tickets, recency(), n).select(
        F.coalesce("ticket_number", F.lit(NOT_AVAILABLE)).alias("ticket_number"),
        preview(F.coalesce("summary", F.lit(""))).alias("summary"),
        non_blank(F.col("latest_comments")).alias("has_comments"),
        F.coalesce("category", F.lit(NOT_AVAILABLE)).alias("category"),
    )
