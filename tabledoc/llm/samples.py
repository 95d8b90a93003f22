"""Samples of bounded size by a hash of the id, without bringing a whole table's candidates together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabledoc.llm.joins import small_side

#: Ids that are ranked for each one asked for, about; and at least so many.
CHOICE, LEAST_CHOICE = 4, 1000


def chosen_ids(ids: DataFrame, most: int) -> DataFrame:
    """At most ``most`` distinct pairs ``_id, _group`` of each ``_group``: those with the smallest hashes of the id.

    A bound on the hash, from the group's estimated number of distinct ids, leaves out nearly all ids
    where they lie, so that one group's ranking sees some ``CHOICE * most`` rows whatever its size.
    Rows without id or group are no candidates; repeated rows count once.
    """
    ids = ids.where(F.col("_id").isNotNull() & F.col("_group").isNotNull()).withColumn("_hash", F.xxhash64("_id"))
    sizes = small_side(ids.groupBy("_group").agg(F.approx_count_distinct("_id").alias("_many")))
    share = F.lit(float(max(CHOICE * most, LEAST_CHOICE))) / F.col("_many")
    # hashes lie evenly from -2^63 to 2^63
    near = ids.join(sizes, "_group").where(F.col("_hash").cast("double") / 2.0**64 + 0.5 <= share)
    order = Window.partitionBy("_group").orderBy("_hash", "_id")
    ranked = near.select("_group", "_id", "_hash").distinct().withColumn("_n", F.row_number().over(order))
    return ranked.where(F.col("_n") <= most).select("_id", "_group")


def texts_of(docs: DataFrame, chosen: DataFrame, on: list[str]) -> DataFrame:
    """One text of each row of ``chosen``, the least of those that share ``on``; null texts are none.

    ``docs`` has ``on`` and ``text``.  Repeated ids give one row, so a sample's bound holds on rows too.
    """
    met = docs.where(F.col("text").isNotNull()).join(small_side(chosen), on)
    return met.groupBy(*chosen.columns).agg(F.min("text").alias("text"))
