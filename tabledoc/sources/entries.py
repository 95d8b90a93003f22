"""Stored entries: ``(data_id, data_type, content, created_at, metadata)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRY_SCHEMA = (
    "data_id string, data_type string, content string, created_at timestamp_ntz, "
    "metadata map<string,string>"
)

# ---- fixed values: row limit and texts of entries ----
MAX_ROWS_PER_TASK = 200
TABLE_SUMMARY = (
    "CSV Table Summary:\nPath: ", "\nRows: ", "\nColumns: ",
    "\nNote: Use query_csv_sql to extract specific data before processing.",
)
NO_ROWS = "(no rows)"
TOO_MANY_ROWS = ("Error: Too many rows (", "). Maximum ", " rows allowed.")


def put_entries(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Entries by id, the newest of each; partially aggregated before the exchange."""
    return (
        stored.unionByName(new)
        .groupBy("data_id")
        .agg(F.max_by(F.struct("data_type", "content", "created_at", "metadata"), "created_at").alias("e"))
        .select("data_id", "e.*")
    )


def find_entries(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """Entries whose id occurs in ``wanted(data_id)``."""
    return stored.join(wanted, "data_id", "left_semi")


def entry_info(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted id whether it exists, with its type and metadata."""
    known = stored.select("data_id", "data_type", "metadata", F.lit(True).alias("known"))
    return wanted.join(known, "data_id", "left").select(
        "data_id", F.coalesce("known", F.lit(False)).alias("found"), "data_type", "metadata"
    )


def entry_payload() -> Column:
    """Text handed on for an entry, by its type; results and objects are kept as JSON."""
    meta = lambda k, default: F.coalesce(F.element_at("metadata", k), F.lit(default))
    grouped = F.regexp_replace(meta("rows", "0"), r"(?<=\d)(?=(?:\d{3})+$)", ",")
    path, count, columns, note = map(F.lit, TABLE_SUMMARY)
    summary = F.concat(
        path, meta("path", "unknown"), count, grouped, columns, meta("column_names", ""), note
    )
    rows = F.when(F.coalesce(F.col("content"), F.lit("[]")).isin("", "[]"), NO_ROWS).otherwise(F.col("content"))
    return (
        F.when(F.col("data_type") == "csv_query_result", rows)
        .when(F.col("data_type") == "csv_table", summary)
        .otherwise(F.col("content"))
    )


def row_guard(
    entries: DataFrame, rows: str = "row_count", limit: int = MAX_ROWS_PER_TASK
) -> DataFrame:
    """Add ``status``: ok, or why a result is too large for one task."""
    message = F.concat(
        F.lit(TOO_MANY_ROWS[0]), F.col(rows), F.lit(f"{TOO_MANY_ROWS[1]}{limit}{TOO_MANY_ROWS[2]}")
    )
    return entries.withColumn("status", F.when(F.col(rows) > limit, message).otherwise("ok"))
