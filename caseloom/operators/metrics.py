"""Counts, modes, samples and resolution times of groups of tickets.

``keys`` are the grouping columns: a cluster, a category, or none for the whole table. Every operator
reduces rows before they are shuffled, so a group that holds most of the table stays cheap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.fixed_values import MODES_SHOWN
from caseloom.functions.dates import hours, is_bad_date, micros_between, month, parsed
from caseloom.functions.text import fixed
from caseloom.session import written

# Values of one bucket of the median's first pass span 2**30 microseconds, about 18 minutes.
MEDIAN_BUCKET_BITS = 30
# Key of the one group that is the whole table.
WHOLE = "_whole"


def value_counts(df: DataFrame, fields: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Rows per value of each field: ``keys, field, value, n``. Nulls are not counted, empty texts are.

    All fields are counted in one pass over the table.
    """
    long = df.select(*keys, *fields).unpivot(list(keys), list(fields), "field", "value")
    counted = long.where(F.col("value").isNotNull()).groupBy(*keys, "field", "value")
    return counted.agg(F.count(F.lit(1)).alias("n"))


def by_count(counts: Column) -> Column:
    """Structs of ``value, n`` from most to least frequent, ties by value."""
    ordered = F.sort_array(F.transform(counts, lambda c: F.struct((-c["n"]).alias("k"), c["value"])))
    return F.transform(ordered, lambda c: F.struct(c["value"], (-c["k"]).alias("n")))


def value_count_maps(df: DataFrame, fields: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One row per group, with a map from value to count per field, most frequent first.

    Meant for fields of few values, as a map holds all values of its group; ``value_counts`` is the
    form without that restriction.
    """
    counts = value_counts(df, fields, keys)
    found = [
        F.map_from_entries(
            by_count(F.collect_list(F.when(F.col("field") == f, F.struct("value", "n"))))
        ).alias(f)
        for f in fields
    ]
    return counts.groupBy(*keys).agg(*found)


def tied_modes(
    df: DataFrame, fields: Sequence[str], keys: Sequence[str], shown: int = MODES_SHOWN
) -> DataFrame:
    """Up to three values tied for the highest count, in ascending order: ``keys, field, modes``.

    The first three by count and value hold them all, so no more than three rows per group and field
    leave a task.
    """
    group = Window.partitionBy(*keys, "field")
    return (
        value_counts(df, fields, keys)
        .withColumn("_at", F.row_number().over(group.orderBy(F.desc("n"), "value")))
        .where(F.col("_at") <= shown)
        .withColumn("_top", F.max("n").over(group))
        .where(F.col("n") == F.col("_top"))
        .groupBy(*keys, "field")
        .agg(F.sort_array(F.collect_list("value")).alias("modes"))
    )


def samples(df: DataFrame, keys: Sequence[str], text: str, n: int, order: list[Column]) -> DataFrame:
    """The first ``n`` texts of each group in the given order: ``keys, samples``."""
    return listed(first_of_group(df, keys, n, order).select(*keys, "_at", text), keys, text)


def first_of_group(df: DataFrame, keys: Sequence[str], n: int, order: list[Column]) -> DataFrame:
    """The first ``n`` rows of each group, numbered in ``_at``; no more than these leave a task."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_at", F.row_number().over(first)).where(F.col("_at") <= n)


def listed(rows: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """The texts of numbered rows as one array per group."""
    ordered = F.sort_array(F.collect_list(F.struct("_at", text)))
    return rows.groupBy(*keys).agg(ordered.alias("_s")).select(*keys, F.col(f"_s.{text}").alias("samples"))


def exact_median(df: DataFrame, value: str, keys: Sequence[str], out: str = "median") -> DataFrame:
    """Interpolated median of a whole-number column per group, exact at any size.

    Rows are first merged into counts per value. One pass over the counts finds the bucket of 2**30
    values that holds each of the two middle positions, a second ranks the values inside it alone. No
    task ever holds the values of a group, however large the group is.
    """
    if not keys:
        return exact_median(df.withColumn(WHOLE, F.lit(0)), value, [WHOLE], out).drop(WHOLE)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_value"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_bucket", F.shiftright("_value", MEDIAN_BUCKET_BITS))
    )
    buckets = counts.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_n"))
    buckets = buckets.withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys)))
    last = F.col("_total") - 1
    middles = F.explode(F.array_distinct(F.array(F.floor(last / 2), F.ceil(last / 2))))
    positions = _with_offset(buckets, keys, "_bucket").withColumn("_middle", middles).where(_holds("_middle"))
    here = positions.select(*keys, "_bucket", (F.col("_middle") - F.col("_before")).alias("_middle"))
    inside = _join_groups(counts, here, [*keys, "_bucket"], "inner")
    found = _with_offset(inside, [*keys, "_bucket", "_middle"], "_value").where(_holds("_middle"))
    return found.groupBy(*keys).agg(F.avg(F.col("_value").cast("double")).alias(out))


def approximate_median(
    df: DataFrame, value: str, keys: Sequence[str], accuracy: int = 10_000, out: str = "median"
) -> DataFrame:
    """A value of each group whose rank is off the middle by at most one part in ``accuracy`` of the group's rows.

    One pass: each task sketches the groups it holds, and the sketches, of a size that ``accuracy`` sets, are merged.
    Groups of less than ``accuracy`` rows get the lower one of their middle values. Values are exact up to 2**53.
    """
    return df.groupBy(*keys).agg(F.percentile_approx(value, 0.5, accuracy).alias(out))


def _with_offset(counts: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Add how many rows of the group come before."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def _holds(position: str) -> Column:
    at = F.col(position)
    return (at >= F.col("_before")) & (at < F.col("_before") + F.col("_n"))


def with_times(tickets: DataFrame) -> DataFrame:
    """Add the parsed dates, and the time to resolution in microseconds."""
    dated = tickets.withColumns({
        "submitted": parsed(F.col("date_submitted")), "resolved": parsed(F.col("resolution_date")),
    })
    return dated.withColumn("resolution_micros", micros_between(F.col("submitted"), F.col("resolved")))


def resolution_metrics(tickets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Size, mean and median hours to resolution, first and last day and busiest month per group.

    Unresolved tickets and texts that are no dates are left out of the times; ``n_bad_dates`` tells how
    many tickets had such a text. Of months tied for busiest the earliest counts. The tickets are read once: their keys
    and times are written down, as the median asks for them three times.
    """
    timed = with_times(tickets)
    bad = is_bad_date(F.col("date_submitted"), F.col("submitted"))
    bad |= is_bad_date(F.col("resolution_date"), F.col("resolved"))
    timed = written(timed.select(*keys, "submitted", "resolution_micros", bad.alias("_bad")), "times")
    micros = F.col("resolution_micros")
    plain = timed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("size"),
        hours(F.avg(micros.cast("decimal(20,0)")).cast("double")).alias("avg_hours"),
        F.min("submitted").alias("earliest"),
        F.max("submitted").alias("latest"),
        F.mode(month(F.col("submitted")), True).alias("peak_month"),
        F.count_if("_bad").alias("n_bad_dates"),
    )
    median = exact_median(timed.select(*keys, "resolution_micros"), "resolution_micros", keys)
    if keys:
        with_median = _join_groups(plain, median, keys, "left")
    else:
        with_median = plain.withColumn("median", median.scalar())
    return with_median.withColumn("median_hours", hours(F.col("median"))).drop("median")


def _join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on grouping columns; a null key is a group like any other."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def roll_up(groups: DataFrame) -> DataFrame:
    """Totals over groups: tickets, mean of the groups' mean hours as shown, number of groups.

    Every group counts the same whatever its size; groups without a mean are left out.
    """
    shown = fixed(F.col("avg_hours"), 1).cast("double")
    return groups.agg(
        F.sum("size").alias("total"),
        fixed(F.avg(shown), 1).cast("double").alias("avg_hours"),
        F.count(F.lit(1)).alias("groups"),
    )
