"""SQL on registered tables with bounded, identified results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabledoc.functions.expressions import short_id
from tabledoc.operators.tabular import DISPLAY_ROWS, STORED_ROWS, normalise_values
from tabledoc.session import materialise


@dataclass(frozen=True)
class QueryResult:
    """A finished query: its id, full row count, all its rows, and the bounded frames of them."""

    result_id: str
    sql: str
    columns: list[str]
    row_count: int
    full: DataFrame
    stored: DataFrame
    display: DataFrame


def bounded_query(spark: SparkSession, sql: str) -> DataFrame:
    """The frame of one query text; anything but a query is rejected by the parser."""
    text = sql.strip().rstrip(";").strip()
    if not text:
        raise ValueError("the SQL query is empty")
    return spark.sql(f"SELECT * FROM (\n{text}\n)")


def run_query(
    spark: SparkSession, data_id: str, sql: str, keep: bool = True,
    stored_rows: int = STORED_ROWS, display_rows: int = DISPLAY_ROWS,
) -> QueryResult:
    """Run ``sql`` against the view ``data_id``.

    ``full`` has every row, ``stored`` and ``display`` the first ones.  With ``keep`` the result is
    executed once and written to the shared folder with its row positions; count and frames read
    that.  For a plain projection of a large table pass ``keep=False``: counting then prunes
    columns, the bounded frames stop early, and ``full`` is the query itself.
    """
    text = sql.strip().rstrip(";")
    result = bounded_query(spark, sql)
    columns = result.columns
    result_id = spark.range(1).select(short_id("csv_query_", F.lit(data_id), F.lit(text))).first()[0]
    if keep:
        kept = materialise(result.withColumn("_row", F.monotonically_increasing_id()), "query")
        count = kept.count()
        full, first = kept.drop("_row"), kept.orderBy("_row").limit(stored_rows).drop("_row")
    else:
        count = result.count()
        full, first = result, result.limit(stored_rows)
    stored = normalise_values(first)
    return QueryResult(result_id, text, columns, count, normalise_values(full), stored, stored.limit(display_rows))
