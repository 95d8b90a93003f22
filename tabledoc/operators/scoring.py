"""Score one keyed text table against another.

The key join is on the whole normalised key; the actual side is reduced to its last row
per key by an aggregate before the join, so duplicates never multiply rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabledoc.functions.expressions import norm_string
from tabledoc.functions.similarity import add_decided, compared
from tabledoc.session import materialise
from tabledoc.sources.delimited import csv_dialects, header_cells, read_delimited

# ---- fixed values of the scoring rule ----
EXPECTED_HEADERS = (
    "Set", "Era", "Set No.", "Symbol", "Japanese Name", "English Equivalent",
    "No. of Cards", "Release Date",
)
KEY_COLUMNS = ("Set", "Era", "Set No.")
URL_COLUMN = "Symbol"
TEXT_COLUMNS = ("Japanese Name", "English Equivalent", "Release Date", "No. of Cards")
HEADER_WEIGHT, ROW_WEIGHT = 0.2, 0.8
PASS_THRESHOLD = 0.9
OUTPUT_MISSING = "output_csv_missing"


def _column(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def row_key(df: DataFrame) -> Column:
    """Normalised composite key; a missing column counts as empty."""
    return F.struct(*[norm_string(_column(df, c)).alias(f"k{i}") for i, c in enumerate(KEY_COLUMNS)])


def missing_headers(columns: list[str], expected: tuple[str, ...] = EXPECTED_HEADERS) -> list[str]:
    return [c for c in expected if c not in columns]


def header_score(columns: list[str]) -> float:
    return 0.0 if missing_headers(columns) else 1.0


def missing_names(names: DataFrame, expected: tuple[str, ...] = EXPECTED_HEADERS) -> DataFrame:
    """The expected headers that are not among ``names`` (column ``name``), in their order: (position, name)."""
    wanted = names.sparkSession.createDataFrame(list(enumerate(expected)), "position int, name string")
    return wanted.join(names.select("name").distinct(), "name", "left_anti").select("position", "name")


def last_wins(df: DataFrame, order: str, *keys: str) -> DataFrame:
    """The row with the greatest ``order`` per key; one row per key leaves each map task."""
    payload = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in payload]), order).alias("m"))
        .select(*keys, "m.*")
    )


def match_rows(expected: DataFrame, actual: DataFrame, order: str = "row_no") -> DataFrame:
    """Left match on the row key: ``key``, ``matched``, and e0.. / a0.. per scored column.

    ``order`` numbers the rows of ``actual``; the last row of a key is compared.
    """
    scored = (URL_COLUMN, *TEXT_COLUMNS)
    left = expected.select(
        row_key(expected).alias("key"),
        *[_column(expected, c).alias(f"e{i}") for i, c in enumerate(scored)],
    )
    right = actual.select(
        row_key(actual).alias("key"),
        F.col(order).alias("_order"),
        *[_column(actual, c).alias(f"a{i}") for i, c in enumerate(scored)],
    )
    right = last_wins(right, "_order", "key").withColumn("matched", F.lit(True)).drop("_order")
    return left.join(right, "key", "left").withColumn(
        "matched", F.coalesce("matched", F.lit(False))
    )


def score_rows(expected: DataFrame, actual: DataFrame, order: str = "row_no") -> DataFrame:
    """Score of every expected row: key, matched, s0..s4 and their mean ``row_score``.

    Most pairs of texts are decided by normalising; the open ones are compared once for each distinct pair and
    joined back, so a text that many rows share is compared once.
    """
    n = 1 + len(TEXT_COLUMNS)
    # unmatched rows send no text to the comparison
    pair = lambda i: tuple(F.when(F.col("matched"), F.col(f"{s}{i}")) for s in "ea")
    rows = add_decided(match_rows(expected, actual, order), "pairs", {f"s{i}": pair(i) for i in range(1, n)}, {"s0": pair(0)})
    rows = rows.select("key", "matched", F.when(F.col("matched"), F.col("pairs")).alias("pairs"), F.monotonically_increasing_id().alias("id"))
    rows = materialise(rows, "matches")
    undecided = rows.select("id", F.posexplode("pairs").alias("i", "p")).where(F.col("p.decided").isNull()).select("id", "i", "p.a", "p.b")
    # at most one for each scored column of a row
    ratios = undecided.join(compared(undecided), ["a", "b"]).groupBy("id").agg(
        F.map_from_entries(F.collect_list(F.struct("i", "ratio"))).alias("ratios")
    )
    decided = lambda i: F.get("pairs", F.lit(i))["decided"]
    scored = rows.join(ratios, "id", "left").select(
        "key", "matched", *[F.coalesce(decided(i), F.element_at("ratios", F.lit(i))).alias(f"s{i}") for i in range(n)]
    )
    total = sum((F.col(f"s{i}") for i in range(1, n)), F.col("s0"))
    return scored.withColumn("row_score", F.when(F.col("matched"), total / n).otherwise(0.0))


def score_columns(scores: DataFrame) -> DataFrame:
    """Mean score per column over matched rows: (column, n, mean_score).  One partial aggregation."""
    names = (URL_COLUMN, *TEXT_COLUMNS)
    return (
        scores.where("matched")
        .select(F.explode(F.create_map(*[x for i, c in enumerate(names) for x in (F.lit(c), F.col(f"s{i}"))]))
                .alias("column", "score"))
        .groupBy("column")
        .agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))
    )


def score_final(scores: DataFrame, header: float, threshold: float = PASS_THRESHOLD) -> DataFrame:
    """One row: totals, means and the verdict.  No expected row at all is a success."""
    totals = scores.agg(
        F.count("*").alias("total_rows"),
        F.count_if(F.col("row_score") > 0).alias("matched_rows"),
        F.avg("row_score").alias("avg_row_score"),
    )
    none = F.col("total_rows") == 0
    final = HEADER_WEIGHT * F.lit(header) + ROW_WEIGHT * F.col("avg_row_score")
    return totals.select(
        "total_rows",
        "matched_rows",
        F.lit(header).alias("header_score"),
        F.when(none, 1.0).otherwise(F.col("avg_row_score")).alias("avg_row_score"),
        F.when(none, 1.0).otherwise(final).alias("final_score"),
    ).withColumn("success", none | (F.col("final_score") >= threshold))


def score_report(scores: DataFrame, header: float) -> DataFrame:
    """The scoring report as (item, value) rows.

    All figures come from one aggregation of the scores, which are computed once.
    """
    names = (URL_COLUMN, *TEXT_COLUMNS)
    totals = scores.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("row_score") > 0).alias("hit"),
        F.avg("row_score").alias("mean"),
        *[F.avg(f"s{i}").alias(f"m{i}") for i in range(len(names))],
    )
    mean = F.when(F.col("total") == 0, 1.0).otherwise(F.col("mean"))
    final = F.when(F.col("total") == 0, 1.0).otherwise(HEADER_WEIGHT * header + ROW_WEIGHT * F.col("mean"))
    pairs = {
        "header_score": F.lit(header), "total_rows": F.col("total").cast("double"),
        "matched_rows": F.col("hit").cast("double"), "avg_row_score": mean, "final_score": final,
    }
    pairs |= {f"column {c}": F.col(f"m{i}") for i, c in enumerate(names)}
    rows = [F.struct(F.lit(k).alias("item"), v.alias("value")) for k, v in pairs.items()]
    return totals.select(F.inline(F.array(*rows)))


def failure(spark, error: str) -> DataFrame:
    """The verdict when there is no output to score."""
    return spark.range(1).select(
        F.lit(False).alias("success"), F.lit(error).alias("error")
    )


def score_output(expected: DataFrame, path: str, threshold: float = PASS_THRESHOLD) -> DataFrame:
    """The verdict on a delimited output: one row (success, error, total_rows, matched_rows, header_score, avg_row_score, final_score).

    No file at ``path`` is the failure ``output_csv_missing``; a file without rows or headers is scored as it is, and no
    expected row at all is a success.  Of equal keys the row that stands last in the file is compared.
    """
    spark = expected.sparkSession
    names = ("total_rows", "matched_rows", "header_score", "avg_row_score", "final_score")
    try:
        dialect = csv_dialects(spark, [path]).first()
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        kinds = expected.agg(F.count("*").alias("n")).select(*[F.lit(None).cast("bigint" if c.endswith("rows") else "double").alias(c) for c in names])
        return kinds.select(F.lit(False).alias("success"), F.lit(OUTPUT_MISSING).alias("error"), *names)
    actual = read_delimited(spark, path, dialect["delimiter"], dialect["quote"], dialect["has_header"])
    # where a row stands: files by name, then splits and lines
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    actual = actual.select("*", place.alias("_place"))
    header = missing_names(header_cells(spark, path)).agg(F.when(F.count("*") == 0, 1.0).otherwise(0.0).alias("header"))
    scored = score_final(score_rows(expected, actual, "_place"), header.first()["header"], threshold)
    return scored.select("success", F.lit(None).cast("string").alias("error"), *names)
