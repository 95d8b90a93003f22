"""Operators on arbitrary tables: description, normalised values, caps, ordered joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabledoc.session import materialise

# ---- fixed values: rows of a result that are shown, and that are handed on ----
DISPLAY_ROWS = 20
STORED_ROWS = 1_000


def describe(df: DataFrame) -> DataFrame:
    """(position, name, type) of the columns and the row count of the table."""
    fields = [
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"))
        for i, f in enumerate(df.schema.fields)
    ]
    return df.agg(F.count("*").alias("row_count")).select(F.inline(F.array(*fields)), "row_count")


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("row_count"))


def normalise_values(df: DataFrame) -> DataFrame:
    """Plain result values: decimals as doubles, dates and times as ISO text, the rest as text."""

    def one(field: T.StructField):
        col, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.StringType, T.IntegralType, T.FractionalType, T.BooleanType)):
            return col.cast("double").alias(field.name) if isinstance(kind, T.DecimalType) else col
        if isinstance(kind, T.DateType):
            return F.date_format(col, "yyyy-MM-dd").alias(field.name)
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            # microseconds are written only where there are some
            whole = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")
            fine = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
            return F.when(F.endswith(fine, F.lit(".000000")), whole).otherwise(fine).alias(field.name)
        if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
            return F.to_json(col).alias(field.name)
        return col.cast("string").alias(field.name)

    return df.select(*[one(f) for f in df.schema.fields])


def capped(df: DataFrame, order: list, rows: int) -> DataFrame:
    """The first rows in order; planned as a distributed top-k."""
    return df.orderBy(*order).limit(rows)


def map_rows(df: DataFrame, fn, out: str = "result", limit: int | None = None) -> DataFrame:
    """A user function over the rows of a result, guarded by its row count where ``limit`` is given.

    ``fn`` takes a row as JSON text.  A result above ``limit`` rows raises; it is materialised
    to be counted where it lies and made only once.
    """
    from tabledoc.operators.text_ops import map_text

    if limit is not None:
        df = materialise(df, "map-rows")
        if df.count() > limit:
            raise ValueError(f"too many rows: at most {limit} are allowed, filter the result first")
    return map_text(df.withColumn("_row", F.to_json(F.struct("*"))), fn, "_row", out).drop("_row")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_time: str,
    right_time: str,
    values: list[str],
    bucket: str,
) -> DataFrame:
    """Each left row with the latest right row at or before its time, or NULL.

    ``bucket`` is SQL over the column ``_at``, rising with time (an hour, a day).  Rows are
    ordered only inside (keys, bucket); the last right row of each bucket is carried over
    the empty and later ones, so a hot key is spread over its buckets.
    """
    payload = F.struct(*[F.col(c) for c in values])
    a = left.select(
        *left.columns, F.col(left_time).alias("_at"), F.lit(1).alias("_side"),
        F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("_value"),
    )
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in left.schema.fields if f.name not in keys]
    b = right.select(
        *[F.col(k) for k in keys], *none, F.col(right_time).alias("_at"), F.lit(0).alias("_side"),
        payload.alias("_value"),
    ).select(*a.columns)
    both = a.unionByName(b).withColumn("_bucket", F.expr(bucket))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_at", "_side")
    # rows without a key match nothing
    keyed = F.lit(True)
    for k in keys:
        keyed = keyed & F.col(k).isNotNull()
    latest = F.when(keyed, F.last("_value", ignorenulls=True).over(inside))
    sums = (
        b.withColumn("_bucket", F.expr(bucket))
        .groupBy(*keys, "_bucket")
        .agg(F.max_by("_value", "_at").alias("_carry"))
    )
    slots = both.where(F.col("_side") == 1).select(*keys, "_bucket").distinct()
    # one row per key and bucket: the value carried into each bucket that has left rows
    timeline = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        slots.join(sums, [*keys, "_bucket"], "full")
        .withColumn("_carry", F.last("_carry", ignorenulls=True).over(timeline))
    )
    return (
        both.withColumn("_value", latest)
        .where(F.col("_side") == 1)
        .join(carried, [*keys, "_bucket"], "left")
        .withColumn("_value", F.coalesce("_value", "_carry"))
        .select(*left.columns, *[F.col(f"_value.{c}").alias(c) for c in values])
    )


def band_join(left: DataFrame, right: DataFrame, low: str, high: str, point: str, width: float) -> DataFrame:
    """Left rows with the right rows whose ``point`` lies in [low, high), by an equi-join.

    The interval is cut into steps of ``width``; each side meets on its step and the bounds
    are checked after.  Choose ``width`` near the interval length.
    """
    steps = F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
    return (
        left.withColumn("_step", F.explode(steps))
        .join(right.withColumn("_step", F.floor(F.col(point) / width)), "_step")
        .where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high)))
        .drop("_step")
    )
