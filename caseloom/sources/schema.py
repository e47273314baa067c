"""The ticket table: its columns and how a loose table is brought to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: column headings of an exported ticket sheet, and our names ---
HEADINGS = {
    "Ticket Number": "ticket_number",
    "Summary": "summary",
    "Project": "project",
    "Category": "category",
    "Severity": "severity",
    "Priority": "priority",
    "Status": "status",
    "Task Type": "task_type",
    "Ticket Owner": "ticket_owner",
    "Date Submitted": "date_submitted",
    "Resolution Date": "resolution_date",
    "Latest Comments": "latest_comments",
}
TEXT_COLUMNS = list(HEADINGS.values())
SCAN_COLUMNS = [
    "summary", "latest_comments", "task_type", "status", "category", "severity", "priority",
    "resolution_date", "date_submitted",
]
CANDIDATE_COLUMNS = [
    "id", "ticket_number", "summary", "project", "category", "severity", "priority", "status",
    "resolution_date", "latest_comments", "ts",
]

TICKET_SCHEMA = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("ts", T.LongType())]
    + [T.StructField(name, T.StringType()) for name in TEXT_COLUMNS]
)


def as_tickets(df: DataFrame) -> DataFrame:
    """Rename sheet headings, letter case and outer spaces aside, and add the ticket columns a table lacks, as nulls.

    Other columns stay as they are.
    """
    known = {old.lower(): new for old, new in HEADINGS.items()}
    renamed: dict[str, str] = {}
    for column in df.columns:
        new = known.get(column.strip().lower())
        if new and new not in df.columns and new not in renamed.values():
            renamed[column] = new
    df = df.withColumnsRenamed(renamed)
    absent = {
        field.name: F.lit(None).cast(field.dataType)
        for field in TICKET_SCHEMA
        if field.name not in df.columns
    }
    return df.withColumns(absent) if absent else df


def fill_missing(df: DataFrame) -> DataFrame:
    """Missing texts become empty texts, as tickets are stored."""
    return df.na.fill("", [c for c in TEXT_COLUMNS if c in df.columns])
