"""Exact quantiles by distributed selection.

A rank is looked up, not sorted for: values are counted by (key, range), the running count tells in which range of a key
the rank lies, and only the rows of that range are counted by value.  Ranges are quantiles of all values
(``operators.ordered``), so neither a key nor a range holds more than a bounded number of rows in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabledoc.operators.ordered import _same, bucketed


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Continuous quantiles of ``value`` per key: the keys and a column for each of ``shares`` (name -> 0 to 1).

    Between two values the quantile is interpolated, as by ``percentile``.  Nulls are left out; a key without
    other values has no row; a null key is a key.
    """
    if any(not 0 <= s <= 1 for s in shares.values()):
        raise ValueError("a share lies between 0 and 1")
    rows = bucketed(df.select(*keys, F.col(value).alias("_v")).where(F.col("_v").isNotNull()), "_v")
    counts = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    of_key = Window.partitionBy(*keys)
    # one row for each key and range
    ranges = counts.withColumns({
        "_total": F.sum("_n").over(of_key),
        "_below": F.coalesce(F.sum("_n").over(of_key.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })
    asked = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(s)).alias("share")) for name, s in shares.items()])
    place = F.col("_a.share") * (F.col("_total") - 1)
    ranks = F.array(
        F.struct(F.floor(place).alias("rank"), (1 - (place - F.floor(place))).alias("part")),
        F.struct(F.ceil(place).alias("rank"), (place - F.floor(place)).alias("part")),
    )
    wanted = (
        ranges.withColumn("_a", F.explode(asked)).withColumn("_r", F.explode(ranks))
        .where("_r.rank >= _below AND _r.rank < _below + _n")
        .select(*keys, "_bucket", "_below", F.col("_a.name").alias("_name"), F.col("_r.rank").alias("_rank"), F.col("_r.part").alias("_part"))
    )
    hit = wanted.select(*keys, "_bucket", "_below").distinct()
    # the values of the ranges that hold a rank
    values = rows.alias("a").join(hit.alias("b"), _same([*keys, "_bucket"])).select(
        *[F.col(f"a.{k}") for k in keys], F.col("a._bucket").alias("_bucket"), F.col("b._below").alias("_below"), F.col("a._v").alias("_v")
    )
    values = values.groupBy(*keys, "_bucket", "_below", "_v").agg(F.count("*").alias("_n"))
    so_far = Window.partitionBy(*keys, "_bucket").orderBy("_v")
    values = values.withColumn("_upto", F.col("_below") + F.sum("_n").over(so_far))
    found = wanted.alias("a").join(values.alias("b"), _same([*keys, "_bucket"])).where(
        (F.col("a._rank") < F.col("b._upto")) & (F.col("a._rank") >= F.col("b._upto") - F.col("b._n"))
    )
    # at most two values for each key and share
    low, high = F.min(F.struct("a._rank", "b._v"))["_v"], F.max(F.struct("a._rank", "b._v"))["_v"]
    above = F.max(F.struct("a._rank", "a._part"))["_part"]
    whole = F.min("a._rank") == F.max("a._rank")
    each = found.groupBy(*[F.col(f"a.{k}") for k in keys], F.col("a._name")).agg(
        F.when(whole, low.cast("double")).otherwise(low + (high - low) * above).alias("_q")
    )
    columns = [F.max(F.when(F.col("_name") == name, F.col("_q"))).alias(name) for name in shares]
    return each.groupBy(*keys).agg(*columns)
