"""Registered queries: name -> (build, DuckDB text of the same result)."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tabledoc.plans.sql_passage import bounded_query
from tabledoc.session import load_table

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Build
    oracle: str | None = None


QUERIES: dict[str, Query] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Build], Build]:
    """Register the decorated function under ``name``."""

    def add(build: Build) -> Build:
        if name in QUERIES:
            raise KeyError(f"query {name} is registered twice")
        QUERIES[name] = Query(build, oracle)
        return build

    return add


def sql_query(name: str, sql: str, oracle: str | None = None) -> None:
    """Register SQL text run through the SQL passage; ``oracle`` only where dialects differ."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        for table in used:
            load_table(spark, sf_dir, table).createOrReplaceTempView(table)
        return bounded_query(spark, sql)

    query(name, oracle or sql)(build)
