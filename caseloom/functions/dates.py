"""Date expressions. Texts that are not dates become null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: date formats read besides the ISO one, in this order; month first where both are possible ---
DATE_FORMATS = [
    "M/d/yyyy[ H:mm[:ss]]",
    "M/d/yyyy h:mm[:ss] a",
    "d/M/yyyy[ H:mm[:ss]]",
    "d/M/yyyy h:mm[:ss] a",
    "yyyy/M/d[ H:mm[:ss]]",
    "M-d-yyyy[ H:mm[:ss]]",
    "d-M-yyyy[ H:mm[:ss]]",
    "d.M.yyyy[ H:mm[:ss]]",
    "d-MMM-yyyy[ H:mm[:ss]]",
    "d MMM yyyy[ H:mm[:ss]]",
    "d MMMM yyyy[ H:mm[:ss]]",
    "MMM d, yyyy[ H:mm[:ss]]",
    "MMMM d, yyyy[ H:mm[:ss]]",
    "yyyy-M-d h:mm[:ss] a",
    "yyyyMMdd",
]


def parsed(text: Column, formats: list[str] = DATE_FORMATS) -> Column:
    """The moment a text names: in ISO form, else in the first of ``formats`` that fits. Blank texts name none."""
    present = F.nullif(F.trim(text), F.lit(""))
    others = [F.try_to_timestamp(present, F.lit(f)) for f in formats]
    return F.coalesce(F.try_to_timestamp(present), *others)


def is_bad_date(text: Column, moment: Column) -> Column:
    """True where a text is present but was not read as a date."""
    return (F.trim(F.coalesce(text, F.lit(""))) != "") & moment.isNull()


def micros_between(start: Column, end: Column) -> Column:
    return F.unix_micros(end) - F.unix_micros(start)


def hours(micros: Column) -> Column:
    return micros / F.lit(3600e6)


def month(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM")


def day(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd")
