"""Window results that survive a hot key.

A plain window sorts a whole key in one task.  These operators give the same values with
windows of bounded size: rows are ordered inside buckets, and what a bucket needs to know
of the others is a small aggregate joined back on (keys, bucket).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows of a bucket, about: no (keys, bucket) has more than one and a half times as many.
BUCKET_ROWS = 1 << 20
#: Buckets of a table at most; the driver holds their borders, and the sketch that finds them a few times as many values.
MOST_BUCKETS = 1 << 14


def _same(keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return on


def _borders(df: DataFrame, value: Column, rows: int, size: int) -> list[float]:
    """Borders that cut the values into ranges of about ``size`` rows, from a quantile sketch.

    The sketch's rank error is a quarter of a range, so a range has at most one and a half times its share
    besides rows equal to its lower border, whatever the spread of the values.
    """
    buckets = min(MOST_BUCKETS, -(-rows // size))
    if buckets < 2:
        return []
    shares = [i / buckets for i in range(1, buckets)]
    return df.select(value.alias("v")).approxQuantile("v", shares, 0.25 / buckets)


def _place(df: DataFrame, value: Column, borders: list[float], out: str) -> DataFrame:
    """Adds the number of the range that holds ``value`` (a double), found by binary search."""
    inner = sorted({b for b in borders if abs(b) != float("inf")})
    if not inner:
        return df.withColumn(out, F.lit(0))
    splits = [-float("inf"), *inner, float("inf")]
    # NaN sorts last and gets the range after the last
    place = Bucketizer(splits=splits, inputCol="_value", outputCol=out, handleInvalid="keep")
    return place.transform(df.withColumn("_value", value)).drop("_value")


def bucketed(df: DataFrame, order: str, width: int | None = None, tie: str | None = None, size: int | None = None) -> DataFrame:
    """Adds ``_bucket``: ordered buckets of bounded size, equal values of ``order`` in one bucket.

    Borders are quantiles, so one outlying value does not bring the others together; nulls sort first.
    ``width`` states equal ranges instead.  ``tie`` names a unique integer that orders rows of equal ``order``
    (which doubles must then represent exactly): a value on more rows than a bucket should hold is set apart and cut by
    quantiles of ``tie``.  ``size`` is the rows of a bucket, by default ``BUCKET_ROWS``.
    """
    size = size or BUCKET_ROWS
    if width is not None:
        return df.withColumn("_bucket", F.floor(F.col(order) / width))
    value = F.coalesce(F.col(order).cast("double"), F.lit(-float("inf")))
    rows = df.count()
    borders = _borders(df, value, rows, size)
    if tie is None or rows <= size:
        return _place(df, value, borders, "_bucket")
    # at most rows / size values
    often = df.groupBy(value.alias("v")).agg(F.count("*").alias("n")).where(F.col("n") > size)
    heavy = [r["v"] for r in often.collect() if r["v"] < math.inf]
    apart = [b for v in heavy for b in (v, math.nextafter(v, math.inf))]
    out = _place(df, value, [*borders, *apart], "_range")
    if not heavy:
        return out.withColumnRenamed("_range", "_bucket")
    is_heavy = value.isin(heavy)
    at = F.col(tie).cast("double")
    hot = df.where(is_heavy)
    out = _place(out, at, _borders(hot, at, hot.count(), size), "_share")
    share = F.when(is_heavy, F.col("_share")).otherwise(0.0)
    return out.withColumn("_bucket", F.struct(F.col("_range").alias("r"), share.alias("s"))).drop("_range", "_share")


def numbered(
    df: DataFrame, keys: list[str], order: str, width: int | None = None, out: str | None = "idx",
    running: dict[str, str] | None = None, tie: str | None = None, then: tuple[str, ...] = (), size: int | None = None,
) -> DataFrame:
    """Exact row numbers per key in the order of ``order``, a unique number (or unique with ``tie`` or ``then``).

    ``tie`` and ``size`` are those of ``bucketed``; ``then`` names columns of any type that order rows of equal ``order``,
    which stay in one bucket.

    ``running`` names running totals (name -> column) made in the same pass; ``out`` may then be
    None.  Numbers and totals inside a bucket are shifted by those of the earlier buckets of the key.
    """
    running = running or {}
    rows = bucketed(df, order, width, tie, size)
    local = Window.partitionBy(*keys, "_bucket").orderBy(order, *([tie] if tie else []), *then)
    so_far = local.rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    made = ({out: (F.row_number().over(local), F.count("*"))} if out else {}) | {
        name: (F.sum(value).over(so_far), F.sum(value)) for name, value in running.items()
    }
    totals = rows.groupBy(*keys, "_bucket").agg(*[total.alias(f"_n_{name}") for name, (_, total) in made.items()])
    shifts = totals.select(
        *keys, "_bucket", *[F.coalesce(F.sum(f"_n_{name}").over(earlier), F.lit(0)).alias(f"_shift_{name}") for name in made]
    )
    return (
        rows.withColumns({name: inside for name, (inside, _) in made.items()})
        .alias("a")
        .join(shifts.alias("b"), _same([*keys, "_bucket"]))
        .select(*[F.col(f"a.{c}") for c in df.columns], *[(F.col(f"a.{n}") + F.col(f"b._shift_{n}")).alias(n) for n in made])
    )


def running_sum(
    df: DataFrame, keys: list[str], order: str, value: str, width: int | None = None, out: str = "running"
) -> DataFrame:
    """Running total per key in the order of ``order``, a unique integer."""
    return numbered(df, keys, order, width, None, {out: value})


def framed(
    df: DataFrame,
    keys: list[str],
    order: str,
    columns: dict[str, Callable[[WindowSpec], Column]],
    before: int = 0,
    after: int = 0,
    width: int | None = None,
    running: dict[str, str] | None = None,
) -> DataFrame:
    """Functions of a row frame (lag, lead, moving aggregates) per key.

    ``columns`` maps a name to a function of the window.  The frame must reach at most
    ``before`` rows back and ``after`` rows ahead: so many rows at the edges of a bucket
    are copied to its neighbours, and each bucket is then complete on its own.  ``running`` adds
    running totals from the pass that numbers the rows.
    """
    size = BUCKET_ROWS if width is None else width
    rows = numbered(df, keys, order, width, "_idx", running)
    rows = rows.withColumn("_slot", F.floor((F.col("_idx") - 1) / size))
    place = F.pmod(F.col("_idx") - 1, F.lit(size))
    reach = F.filter(
        F.array(
            F.struct(F.col("_slot").alias("s"), F.lit(True).alias("own")),
            F.when(place >= size - before, F.struct((F.col("_slot") + 1).alias("s"), F.lit(False).alias("own"))),
            F.when(place < after, F.struct((F.col("_slot") - 1).alias("s"), F.lit(False).alias("own"))),
        ),
        lambda p: p.isNotNull(),
    )
    spread = rows.withColumn("_to", F.explode(reach))
    window = Window.partitionBy(*keys, "_to.s").orderBy("_idx")
    return (
        spread.withColumns({name: make(window) for name, make in columns.items()})
        .where("_to.own")
        .select(*df.columns, *(running or {}), *columns)
    )


def ranked(df: DataFrame, keys: list[str], value: str, step: float | None = None) -> DataFrame:
    """``rank``, ``dense_rank``, ``percent_rank`` and ``cume_dist`` per key by a number ``value``.

    Ranks depend on the value only, so they are computed on (keys, value) counts, a row per
    distinct value after partial aggregation, and joined back.  Values are ordered inside
    buckets of bounded size (or ranges of ``step``); the totals of the lower ones, a row per bucket, are added.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    # counting rows is cheaper than counting their values, which are no more
    few = step is None and df.count() <= BUCKET_ROWS
    counts = counts.withColumn("_range", F.lit(0)) if few else bucketed(counts, value, step).withColumnRenamed("_bucket", "_range")
    inside = Window.partitionBy(*keys, "_range").orderBy(value)
    lower = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    ranges = (
        counts.groupBy(*keys, "_range")
        .agg(F.sum("_n").alias("_rows"), F.count("*").alias("_values"))
        .withColumn("_below", F.coalesce(F.sum("_rows").over(lower), zero))
        .withColumn("_dense", F.coalesce(F.sum("_values").over(lower), zero))
        .withColumn("_total", F.sum("_rows").over(Window.partitionBy(*keys)))
    )
    before = F.coalesce(F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), zero)
    ranks = (
        counts.withColumn("_before", before)
        .withColumn("_nth", F.row_number().over(inside))
        .alias("a")
        .join(ranges.alias("b"), _same([*keys, "_range"]))
        .select(
            *[F.col(f"a.{k}") for k in keys], F.col(f"a.{value}"), "_n", "_total",
            (F.col("_below") + F.col("_before") + 1).alias("rank"),
            (F.col("_dense") + F.col("_nth")).cast("bigint").alias("dense_rank"),
        )
        .withColumn(
            "percent_rank",
            F.when(F.col("_total") > 1, (F.col("rank") - 1) / (F.col("_total") - 1)).otherwise(0.0),
        )
        .withColumn("cume_dist", (F.col("rank") - 1 + F.col("_n")) / F.col("_total"))
    )
    new = ["rank", "dense_rank", "percent_rank", "cume_dist"]
    return (
        df.alias("a")
        .join(ranks.alias("b"), _same([*keys, value]))
        .select(*[F.col(f"a.{c}") for c in df.columns], *[F.col(f"b.{c}") for c in new])
    )
