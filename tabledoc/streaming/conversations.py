"""Incremental conversation state.

Each function turns a stream of messages into a streaming aggregate whose state is the conversation state of
the batch operator with the same name.  All are native aggregates: partially aggregated before the exchange, state in the
state store, one row per key.

``run`` drives a stream to the end of its input.  ``publish`` then hands out the updates: it reads what each batch
changed from the state's change log and writes it to a keyed sink, of which ``read_latest`` gives the newest row of
each key.  All three may be repeated or begun again at any time: a batch has its number from the checkpoint, and what was
not committed to the sink is written anew.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabledoc.operators.conversations import (
    GATE_OPENER,
    ROUTE_THRESHOLD,
    SUPERSEDED_ARGUMENT,
    SUPERSEDED_TOOL,
    has_image,
    message_length,
    route_of,
)
from tabledoc.session import scratch_dir


def message_stream(
    spark: SparkSession, path: str, schema: T.StructType, name: str | None = None, files: int = 10_000, base: str | None = None
) -> DataFrame:
    """Parquet files below ``path`` as a stream of at most ``files`` a batch; ``name`` is a glob.

    ``path`` may be a glob too; ``base`` is then the folder from which on partition folders are looked for.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    if name:
        reader = reader.option("pathGlobFilter", name)
    if base:
        reader = reader.option("basePath", base)
    return reader.parquet(path)


Expiry = tuple[str, str] | None


def _grouped(rows: DataFrame, keys: tuple[str, ...], expire: Expiry) -> GroupedData:
    """Rows by keys; with ``expire`` (time column, duration) also by spans of that length.

    The state of a span is dropped once rows have come that are later than its end by the duration.
    """
    if expire is None:
        return rows.groupBy(*keys)
    time, duration = expire
    return rows.withWatermark(time, duration).groupBy(*keys, F.window(time, duration))


def upsert_state(messages: DataFrame, expire: Expiry = None) -> DataFrame:
    """Newest content and first position per message id."""
    newest = F.max_by(F.struct("type", "name", "content", "parts", "tool_calls", "tool_call_id"), "seq")
    return _grouped(messages, ("conv_id", "msg_id"), expire).agg(F.min("seq").alias("seq"), newest.alias("m"))


def latest_call_state(
    messages: DataFrame, tool: str = SUPERSEDED_TOOL, argument: str = SUPERSEDED_ARGUMENT, expire: Expiry = None
) -> DataFrame:
    """Latest call of ``tool`` per value of ``argument``."""
    time = [expire[0]] if expire else []
    calls = messages.where(F.size("tool_calls") > 0).select(
        "conv_id", "seq", *time, F.posexplode("tool_calls").alias("call_no", "call")
    )
    keyed = calls.where((F.col("call.name") == tool) & F.col("call.id").isNotNull()).select(
        "conv_id", F.element_at("call.args", argument).alias("key"), "seq", *time, "call_no", F.col("call.id").alias("id")
    )
    return _grouped(keyed.where(F.col("key") != ""), ("conv_id", "key"), expire).agg(
        F.max(F.struct("seq", "call_no", "id")).alias("m")
    )


def route_state(messages: DataFrame, expire: Expiry = None) -> DataFrame:
    """Length and image flag per conversation."""
    return _grouped(messages, ("conv_id",), expire).agg(
        F.sum(message_length()).alias("total_length"), F.bool_or(has_image()).alias("has_image")
    )


def gate_state(messages: DataFrame, opener: str = GATE_OPENER, expire: Expiry = None) -> DataFrame:
    """Whether the opener has been seen in a conversation."""
    return _grouped(messages, ("conv_id",), expire).agg(
        F.bool_or(F.coalesce(F.col("name") == opener, F.lit(False))).alias("opened")
    )


def run(aggregate: DataFrame, place: str) -> None:
    """Run a streaming aggregate over all input that is there, from where the checkpoint ``place`` stands."""
    query = (
        aggregate.writeStream.outputMode("update")
        .format("noop")
        .option("checkpointLocation", place)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _values(rows: DataFrame) -> list[Column]:
    """The aggregation buffers in their order as ``v0, v1, ...``."""
    buffers = [f.name for f in rows.schema["value"].dataType.fields]
    return [F.col("value").getField(b).alias(f"v{i}") for i, b in enumerate(buffers)]


def read_state(spark: SparkSession, place: str) -> DataFrame:
    """The whole state as (key.*, v0, v1, ...), read from the checkpoint."""
    state = spark.read.format("statestore").load(place)
    return state.select("key.*", *_values(state))


def updates(spark: SparkSession, place: str, first: int = 0, last: int | None = None) -> DataFrame:
    """What the batches from ``first`` to ``last`` changed: (batch_id, removed, key.*, v0, v1, ...), a row for each key of a batch."""
    reader = spark.read.format("statestore").option("readChangeFeed", True).option("changeStartBatchId", first)
    if last is not None:
        reader = reader.option("changeEndBatchId", last)
    feed = reader.load(place)
    return feed.select("batch_id", (F.col("change_type") != "update").alias("removed"), "key.*", *_values(feed))


def _commits(spark: SparkSession, out: str) -> DataFrame:
    try:
        return spark.read.schema("upto bigint").parquet(f"{out}/commits")
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "upto bigint")


def publish(spark: SparkSession, place: str, out: str) -> int:
    """Write the changes of all batches since the last commit to the sink ``out``; the number of the last batch.

    The rows go to a folder named by the last batch, which is replaced if it is there, and count once the commit is
    written; so a run that broke off leaves nothing behind that is read, and the next one writes the same rows.
    """
    last = spark.read.format("state-metadata").load(place).agg(F.max("maxBatchId")).first()[0]
    done = _commits(spark, out).agg(F.max("upto")).first()[0]
    first = 0 if done is None else done + 1
    if first <= last:
        updates(spark, place, first, last).write.mode("overwrite").parquet(f"{out}/rows/upto={last}")
        spark.range(last, last + 1).select(F.col("id").alias("upto")).write.mode("append").parquet(f"{out}/commits")
    return last


def read_latest(spark: SparkSession, out: str, *keys: str) -> DataFrame:
    """The newest committed row of each key of a sink, without those that were removed."""
    rows = spark.read.option("basePath", f"{out}/rows").parquet(f"{out}/rows")
    rows = rows.join(F.broadcast(_commits(spark, out).distinct()), "upto", "left_semi").drop("upto")
    payload = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*payload), "batch_id").alias("m"))
    return newest.where(~F.col("m.removed")).select(*keys, *[F.col(f"m.{c}").alias(c) for c in payload if c not in ("batch_id", "removed")])


def run_state(aggregate: DataFrame, label: str, place: str | None = None, out: str | None = None) -> DataFrame:
    """Run a streaming aggregate to the end of its input and publish it; the state as it is read from the sink.

    ``place`` and ``out`` are the checkpoint and the sink of an earlier run to go on from; by default new ones.
    """
    spark = aggregate.sparkSession
    place, out = place or scratch_dir(spark, label), out or scratch_dir(spark, f"{label}-sink")
    keys = [c for c in aggregate.columns if c in ("conv_id", "msg_id", "key", "window")]
    run(aggregate, place)
    publish(spark, place, out)
    return read_latest(spark, out, *keys)


def stream_upsert(messages: DataFrame, expire: Expiry = None, **places: str) -> DataFrame:
    state = run_state(upsert_state(messages, expire), "upsert", **places)
    if expire:
        state = state.groupBy("conv_id", "msg_id").agg(F.min("v0").alias("v0"), F.max_by("v1", "window").alias("v1"))
    return state.select("conv_id", "msg_id", F.col("v0").alias("seq"), "v1.*")


def stream_latest(messages: DataFrame, expire: Expiry = None, places: dict[str, str] | None = None, **options: str) -> DataFrame:
    state = run_state(latest_call_state(messages, expire=expire, **options), "latest", **(places or {}))
    if expire:
        state = state.groupBy("conv_id", "key").agg(F.max("v0").alias("v0"))
    return state.select("conv_id", "key", "v0.*")


def stream_route(
    messages: DataFrame, threshold: int = ROUTE_THRESHOLD, multimodal: bool = True, expire: Expiry = None, **places: str
) -> DataFrame:
    state = run_state(route_state(messages, expire), "route", **places)
    if expire:
        state = state.groupBy("conv_id").agg(F.sum("v0").alias("v0"), F.bool_or("v1").alias("v1"))
    state = state.select("conv_id", F.col("v0").alias("total_length"), F.col("v1").alias("has_image"))
    return state.withColumn(
        "route", route_of(F.col("total_length"), F.col("has_image"), threshold, multimodal)
    )


def stream_gate(messages: DataFrame, opener: str = GATE_OPENER, expire: Expiry = None, **places: str) -> DataFrame:
    state = run_state(gate_state(messages, opener, expire), "gate", **places)
    if expire:
        state = state.groupBy("conv_id").agg(F.bool_or("v0").alias("v0"))
    return state.select("conv_id", F.col("v0").alias("opened"))
