"""Roll-ups of benchmark runs.

``runs(model, benchmark, iteration, success, duration_seconds, error, metrics)``
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabledoc.operators.ordered import numbered

RUN_SCHEMA = (
    "model string, benchmark string, iteration bigint, success boolean, "
    "duration_seconds double, error string, metrics map<string,double>"
)
SCORE = "final_score"


def run_summary(runs: DataFrame) -> DataFrame:
    """Overall, per model and per model x benchmark, in one rollup.

    ``level`` is 0 for model x benchmark, 1 for model, 3 overall; the standard deviation is
    that of a sample, 0 for a single run.
    """
    return (
        runs.rollup("model", "benchmark")
        .agg(
            F.grouping_id().alias("level"),
            F.count("*").alias("runs"),
            F.count_if("success").alias("successes"),
            (F.count_if("success") * 100 / F.count("*")).alias("success_rate"),
            F.avg("duration_seconds").alias("avg_duration"),
            F.coalesce(F.stddev_samp("duration_seconds"), F.lit(0.0)).alias("std_duration"),
            F.sum("duration_seconds").alias("total_duration"),
            F.bool_and("success").alias("all_passed"),
        )
    )


def run_scores(runs: DataFrame) -> DataFrame:
    """Mean final score over the runs that have one."""
    score = F.element_at("metrics", SCORE)
    return runs.groupBy("model", "benchmark").agg(
        F.count(score).alias("scored_runs"), F.avg(score).alias("avg_score")
    )


def run_score_list(runs: DataFrame, page: int = 100, width: int | None = None) -> DataFrame:
    """``1=0.95, 2=...`` per model x benchmark, ``page`` runs to a line.

    Runs are counted in iteration order, runs without a score keep their number.  A list
    is cut into lines of bounded length, none is dropped: (model, benchmark, page_no, scores).
    """
    score = F.element_at("metrics", SCORE)
    one = F.concat(F.col("idx").cast("string"), F.lit("="), F.format_string("%.2f", "score"))
    entries = F.array_sort(F.collect_list(F.struct("idx", one.alias("text"))))
    return (
        numbered(
            runs.select("model", "benchmark", "iteration", score.alias("score")),
            ["model", "benchmark"], "iteration", width,
        )
        .where(F.col("score").isNotNull())
        .withColumn("page_no", F.floor((F.col("idx") - 1) / page))
        .groupBy("model", "benchmark", "page_no")
        .agg(F.array_join(F.transform(entries, lambda e: e["text"]), ", ").alias("scores"))
    )


def run_records(runs: DataFrame) -> DataFrame:
    """The exported record of each run: one JSON object per row."""
    record = F.struct(
        "benchmark", "model", "success", F.col("duration_seconds").alias("duration"), "error"
    )
    return runs.select("model", "benchmark", "iteration", F.to_json(record).alias("record"))
