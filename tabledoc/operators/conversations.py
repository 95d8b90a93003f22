"""Operators on conversation messages.

``messages(conv_id, seq, msg_id, type, name, content, parts, tool_calls, tool_call_id)``:
``content`` is NULL when the message is a list of typed ``parts``.

A conversation may hold a large share of all rows, so nothing here orders a whole
conversation in one task: totals and latest values are aggregates (partial before the
exchange), "last k" uses a rank limit that Spark applies before and after the exchange,
and results return to the messages by joins that AQE can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabledoc.session import materialise

MESSAGE_SCHEMA = (
    "conv_id bigint, seq int, msg_id string, type string, name string, content string, "
    "parts array<struct<type:string,text:string>>, "
    "tool_calls array<struct<id:string,name:string,args:map<string,string>>>, "
    "tool_call_id string"
)

# ---- fixed values of the conversation operators ----
SUPERSEDED_TOOL = "create_python_script"
SUPERSEDED_ARGUMENT = "path"
IMAGE_TYPES = ("image", "image_url")
IMAGE_STUB = "[Image was analyzed in previous turn]"
ROUTE_THRESHOLD = 10_000
GATED_PREFIX = "web_"
GATE_OPENER = "web_load_web_page"
CLEAR_TRIGGER_TOKENS = 10_000
CLEAR_KEEP = 3
CLEARED = "[cleared]"
SUMMARY_TRIGGER_TOKENS = 20_000
SUMMARY_KEEP = 5


def message_length() -> Column:
    """Characters of string content plus those of text parts."""
    parts = F.expr(
        "aggregate(filter(coalesce(parts, array()), p -> p.type = 'text'), 0L, (n, p) -> n + length(coalesce(p.text, '')))"
    )
    return F.coalesce(F.length("content"), F.lit(0)).cast("bigint") + parts


def has_image() -> Column:
    """Whether one of the parts is an image."""
    kinds = ", ".join(f"'{t}'" for t in IMAGE_TYPES)
    return F.expr(f"exists(coalesce(parts, array()), p -> p.type IN ({kinds}))")


def tokens_of(chars: Column) -> Column:
    """Token estimate: a token per four characters, rounded up."""
    return F.ceil(chars / 4).cast("bigint")


# --------------------------------------------------------------- per conversation

def conversation_length(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg(F.sum(message_length()).alias("total_length"))


def conversation_images(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg(F.bool_or(has_image()).alias("has_image"))


def last_ai(messages: DataFrame) -> DataFrame:
    """Position of the last AI message: (conv_id, last_ai), NULL without one."""
    return messages.groupBy("conv_id").agg(
        F.max(F.when(F.col("type") == "ai", F.col("seq"))).alias("last_ai")
    )


def last_message(messages: DataFrame) -> DataFrame:
    """The final message of every conversation."""
    latest = F.max_by(F.struct("seq", "type", "content", "parts"), "seq").alias("m")
    return messages.groupBy("conv_id").agg(latest).select("conv_id", "m.*")


def route_of(length: Column, image: Column, threshold: int, multimodal: bool) -> Column:
    by_length = F.when(length > threshold, "remote").otherwise("local")
    return F.when(image, "multimodal").otherwise(by_length) if multimodal else by_length


def route_conversations(
    messages: DataFrame, threshold: int = ROUTE_THRESHOLD, multimodal: bool = True
) -> DataFrame:
    """Which kind of model takes the conversation: (conv_id, total_length, has_image, route)."""
    totals = messages.groupBy("conv_id").agg(
        F.sum(message_length()).alias("total_length"), F.bool_or(has_image()).alias("has_image")
    )
    return totals.withColumn(
        "route", route_of(F.col("total_length"), F.col("has_image"), threshold, multimodal)
    )


def gate_tools(
    messages: DataFrame,
    tools: list[str],
    prefix: str = GATED_PREFIX,
    opener: str = GATE_OPENER,
) -> DataFrame:
    """Tools available to every conversation: (conv_id, tool).

    Tools with ``prefix``, except ``opener`` itself, need a message named ``opener``.  The
    tool list is a parameter, so it is exploded per conversation instead of joined.
    """
    opened = messages.groupBy("conv_id").agg(
        F.coalesce(F.bool_or(F.col("name") == opener), F.lit(False)).alias("opened")
    )
    everything = F.array(*[F.lit(t) for t in tools])
    free = F.array(*[F.lit(t) for t in tools if not t.startswith(prefix) or t == opener])
    allowed = F.when(F.col("opened"), everything).otherwise(free.cast("array<string>"))
    return opened.select("conv_id", F.explode(allowed).alias("tool"))


# --------------------------------------------------------------- superseded calls

def tool_calls(messages: DataFrame) -> DataFrame:
    """One row per tool call: (conv_id, seq, call_no, id, name, args)."""
    return messages.where(F.size("tool_calls") > 0).select(
        "conv_id", "seq", F.posexplode("tool_calls").alias("call_no", "call")
    ).select("conv_id", "seq", "call_no", "call.*")


def tool_call_log(messages: DataFrame) -> DataFrame:
    """Tool name and JSON arguments per call."""
    return tool_calls(messages).select(
        "conv_id", "seq", "call_no", "name", F.to_json("args").alias("input")
    )


def latest_calls(
    messages: DataFrame, tool: str = SUPERSEDED_TOOL, argument: str = SUPERSEDED_ARGUMENT
) -> DataFrame:
    """The latest call of ``tool`` for each value of ``argument``: (conv_id, key, seq, call_no, id)."""
    calls = keyed_calls(messages, tool, argument)
    position = F.struct("seq", "call_no", "id")
    return calls.groupBy("conv_id", "key").agg(F.max(position).alias("m")).select(
        "conv_id", "key", "m.*"
    )


def keyed_calls(messages: DataFrame, tool: str, argument: str) -> DataFrame:
    return (
        tool_calls(messages)
        .where((F.col("name") == tool) & F.col("id").isNotNull())
        .withColumn("key", F.element_at("args", argument))
        .where(F.col("key") != "")
        .select("conv_id", "seq", "call_no", "id", "key")
    )


def _slot(kind: Column, name: Column) -> Column:
    return F.struct(kind.alias("is_result"), name.cast("string").alias("id"))


def _own_slot() -> Column:
    """Where a message's calls or answer are looked up: a tool result by its call, others by their position."""
    is_result = F.coalesce((F.col("type") == "tool") & F.col("tool_call_id").isNotNull(), F.lit(False))
    return _slot(is_result, F.when(is_result, F.col("tool_call_id")).otherwise(F.col("seq").cast("string")))


def _calls_left() -> Column:
    return F.expr("filter(tool_calls, c -> NOT coalesce(array_contains(hidden, c.id), false))")


def superseded(messages: DataFrame, tool: str = SUPERSEDED_TOOL, argument: str = SUPERSEDED_ARGUMENT) -> DataFrame:
    """What superseded calls mean for the messages: (conv_id, slot, hidden), written once.

    ``hidden`` has the calls of a message that a later call for the same argument replaces, and for a result its call.
    """
    calls = keyed_calls(messages, tool, argument)
    latest = calls.groupBy("conv_id", "key").agg(F.max(F.struct("seq", "call_no")).alias("m")).select("conv_id", "m.*")
    gone = calls.join(latest, ["conv_id", "seq", "call_no"], "left_anti")
    slots = F.array(_slot(F.lit(False), F.col("seq")), _slot(F.lit(True), F.col("id")))
    # bounded by the calls of one message
    marks = gone.select("conv_id", F.explode(slots).alias("slot"), "id").groupBy("conv_id", "slot").agg(F.collect_set("id").alias("hidden"))
    return materialise(marks, "superseded")


def _stays() -> Column:
    """Whether a message, met with its mark, is kept."""
    emptied = (F.size(_calls_left()) <= 0) & ~has_content()
    return F.col("hidden").isNull() | (~F.col("slot.is_result") & ~emptied)


def has_content() -> Column:
    """Whether a message says something besides its calls."""
    return (F.coalesce(F.length("content"), F.lit(0)) > 0) | (F.coalesce(F.size("parts"), F.lit(0)) > 0)


def drop_superseded(
    messages: DataFrame, tool: str = SUPERSEDED_TOOL, argument: str = SUPERSEDED_ARGUMENT, marks: DataFrame | None = None
) -> DataFrame:
    """Messages without superseded calls and their results.

    An AI message left without calls stays if it has content; a tool result has no calls of its own.  ``marks`` is a result
    of ``superseded``.  The one join is on (conversation, call or position), so one long conversation spreads.
    """
    marks = superseded(messages, tool, argument) if marks is None else marks
    rows = messages.withColumn("slot", _own_slot()).join(marks, ["conv_id", "slot"], "left").where(_stays())
    left = F.when(F.col("hidden").isNotNull(), _calls_left()).otherwise(F.col("tool_calls"))
    return rows.withColumn("tool_calls", left).select(*messages.columns)


# --------------------------------------------------------------- rewriting

def stub_images(messages: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """Image parts of messages before the last AI message become a text stub; ``ends`` is a result of ``last_ai``."""
    kinds = ", ".join(f"'{t}'" for t in IMAGE_TYPES)
    stubbed = F.expr(
        f"transform(parts, p -> CASE WHEN p.type IN ({kinds}) THEN "
        f"named_struct('type', 'text', 'text', '{IMAGE_STUB}') ELSE p END)"
    )
    seen = F.col("seq") < F.col("last_ai")
    return (
        messages.join(last_ai(messages) if ends is None else ends, "conv_id", "left")
        .withColumn("parts", F.when(seen & has_image(), stubbed).otherwise(F.col("parts")))
        .select(*messages.columns)
    )


def last_k(messages: DataFrame, k: int) -> DataFrame:
    """Positions of the last ``k`` messages of each conversation: (conv_id, seq).

    The filter on the row number becomes a rank limit on both sides of the exchange: a map
    task sends at most ``k`` rows of a conversation.
    """
    newest = Window.partitionBy("conv_id").orderBy(F.desc("seq"))
    return (
        messages.select("conv_id", "seq")
        .withColumn("rn", F.row_number().over(newest))
        .where(F.col("rn") <= k)
        .select("conv_id", "seq")
    )


def clear_tool_results(
    messages: DataFrame,
    trigger_tokens: int = CLEAR_TRIGGER_TOKENS,
    keep: int = CLEAR_KEEP,
    placeholder: str = CLEARED,
) -> DataFrame:
    """In conversations over the token budget, tool results but the last ``keep`` are cleared."""
    over = (
        messages.groupBy("conv_id")
        .agg(F.sum(tokens_of(message_length())).alias("tokens"))
        .where(F.col("tokens") > trigger_tokens)
        .select("conv_id", F.lit(True).alias("over"))
    )
    tool = F.col("type") == "tool"
    recent = last_k(messages.where(tool), keep).withColumn("recent", F.lit(True))
    clear = F.coalesce(tool, F.lit(False)) & F.col("over").isNotNull() & F.col("recent").isNull()
    return (
        messages.join(over, "conv_id", "left")
        .join(recent, ["conv_id", "seq"], "left")
        .withColumn("content", F.when(clear, placeholder).otherwise(F.col("content")))
        .withColumn("parts", F.when(~clear, F.col("parts")))
        .select(*messages.columns)
    )


def summarise_split(
    messages: DataFrame,
    trigger_tokens: int = SUMMARY_TRIGGER_TOKENS,
    keep: int = SUMMARY_KEEP,
) -> DataFrame:
    """Which messages a summary would replace: (conv_id, seq, summarised)."""
    over = (
        messages.groupBy("conv_id")
        .agg(F.sum(tokens_of(message_length())).alias("tokens"))
        .where(F.col("tokens") > trigger_tokens)
        .select("conv_id", F.lit(True).alias("over"))
    )
    recent = last_k(messages, keep).withColumn("recent", F.lit(True))
    return (
        messages.select("conv_id", "seq")
        .join(over, "conv_id", "left")
        .join(recent, ["conv_id", "seq"], "left")
        .select(
            "conv_id",
            "seq",
            (F.col("over").isNotNull() & F.col("recent").isNull()).alias("summarised"),
        )
    )


def upsert_messages(old: DataFrame, new: DataFrame) -> DataFrame:
    """Messages of both sets by id: the newest content at the first position.

    ``new`` must be numbered after ``old``.  One aggregation, no self-join.
    """
    newest = F.max_by(F.struct("type", "name", "content", "parts", "tool_calls", "tool_call_id"), "seq")
    return (
        old.unionByName(new)
        .groupBy("conv_id", "msg_id")
        .agg(F.min("seq").alias("seq"), newest.alias("m"))
        .select("conv_id", "seq", "msg_id", "m.*")
    )


def prepare_turn(messages: DataFrame, threshold: int = ROUTE_THRESHOLD, multimodal: bool = True) -> DataFrame:
    """The steps before a model call in their order: superseded calls, images, routing.

    The superseded calls and the place where the AI speaks last without them are found first, from narrow columns, and
    written; the messages are then read once.
    """
    marks = superseded(messages)
    met = messages.withColumn("slot", _own_slot()).join(marks, ["conv_id", "slot"], "left")
    ends = materialise(met.groupBy("conv_id").agg(F.max(F.when((F.col("type") == "ai") & _stays(), F.col("seq"))).alias("last_ai")), "ends")
    return route_conversations(stub_images(drop_superseded(messages, marks=marks), ends), threshold, multimodal)
