"""Sinks.

Partitioned writes ask for a rebalance on their partition columns: adaptive execution then
joins small partitions and splits a hot one, so no value of a column becomes one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabledoc.functions.expressions import slug


def write_text(df: DataFrame, path: str, column: str, append: bool = False) -> None:
    """One text column as lines; overwrites unless ``append``."""
    df.select(F.col(column).alias("value")).write.mode("append" if append else "overwrite").text(path)


def write_pages(pages: DataFrame, path: str, prefix: int = 2) -> None:
    """Page records by the first hex digits of their id.

    A folder per page does not scale; 16 ** ``prefix`` folders do, and a lookup by id
    still prunes to one.
    """
    bucket = F.substring("data_id", len("page_") + 1, prefix)
    (
        pages.withColumn("bucket", bucket)
        .hint("rebalance", "bucket")
        .write.mode("overwrite")
        .partitionBy("bucket")
        .parquet(path)
    )


def write_sections(tables: DataFrame, path: str, key: str = "doc_id") -> None:
    """Table rows by section slug; a row is one CSV field list, tables stay apart."""
    rows = tables.select(
        F.coalesce(F.nullif(slug(F.coalesce("section", F.lit("Unknown"))), F.lit("")), F.lit("unknown"))
        .alias("section_slug"),
        key,
        "table_no",
        "row_no",
        F.to_json("cells").alias("cells"),
    )
    (
        rows.hint("rebalance", "section_slug")
        .sortWithinPartitions("section_slug", key, "table_no", "row_no")
        .write.mode("overwrite")
        .partitionBy("section_slug")
        .option("escape", '"')
        .csv(path, header=True)
    )


def write_combined(combined: DataFrame, path: str, key: str = "doc_id") -> None:
    """All tables in order: the sort range-partitions, part files in name order are the file."""
    line = F.array_join(
        F.transform(
            "cells",
            lambda c: F.when(
                c.rlike('[",\n\r]'),
                F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')),
            ).otherwise(c),
        ),
        ",",
    )
    combined.orderBy(key, "table_no", "part", "row_no").select(line.alias("value")).write.mode(
        "overwrite"
    ).text(path)


def write_runs(runs: DataFrame, path: str, prefix: int = 1) -> None:
    """Run output as model / benchmark / bucket folders; a slash in a model becomes ``_``.

    A folder per run does not scale; the bucket is the first ``prefix`` hex digits of the MD5 of the
    run's name, which every row keeps as ``run``, so a lookup by run still prunes to one folder.
    """
    run = F.concat(F.lit("run_"), "iteration")
    rows = runs.select(
        F.replace("model", F.lit("/"), F.lit("_")).alias("model"),
        "benchmark",
        F.substring(F.md5(run), 1, prefix).alias("bucket"),
        run.alias("run"),
        "success", "duration_seconds", "error",
    )
    (
        rows.hint("rebalance", "model", "benchmark", "bucket")
        .write.mode("overwrite")
        .partitionBy("model", "benchmark", "bucket")
        .json(path)
    )


def write_records(records: DataFrame, path: str, column: str = "record") -> None:
    """JSON lines of already serialised records."""
    records.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
