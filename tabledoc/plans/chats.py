"""Queries over ``conversations``, also as messages with tool calls and images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabledoc.operators import conversations as cv
from tabledoc.plans.registry import query
from tabledoc.session import load_table

# --------------------------------------------------------------- messages made of the turns
# n = characters of the turn.  Assistant turns call a tool, two files in turn; later user
# turns of even length are tool results; some user turns carry an image.

_TYPE = "CASE WHEN role = 'assistant' THEN 'ai' WHEN role = 'system' THEN 'system' WHEN turn >= 2 AND length(text) % 2 = 0 THEN 'tool' ELSE 'human' END"
_NAME = "CASE WHEN role = 'user' AND turn >= 2 AND length(text) % 2 = 0 THEN CASE WHEN length(text) % 5 = 0 THEN 'web_load_web_page' ELSE 'create_python_script' END END"
_IMAGE = "role = 'user' AND length(text) % 3 = 1"
_CALL_NAME = "CASE WHEN length(text) % 4 = 0 THEN 'shell_run' ELSE 'create_python_script' END"
_CONTENT = f"CASE WHEN {_IMAGE} THEN NULL WHEN role = 'assistant' AND length(text) % 3 = 0 THEN '' ELSE text END"
_ANSWER = "CASE WHEN role = 'user' AND turn >= 2 AND length(text) % 2 = 0 THEN concat('c', conv_id, '_', turn - 1) END"


def messages(turns: DataFrame) -> DataFrame:
    """Messages in the package schema; also used on a stream."""
    return turns.select(
        "conv_id",
        F.col("turn").cast("int").alias("seq"),
        F.expr("concat('m', conv_id, '_', turn)").alias("msg_id"),
        F.expr(_TYPE).alias("type"),
        F.expr(_NAME).alias("name"),
        F.expr(_CONTENT).alias("content"),
        F.expr(
            f"CASE WHEN {_IMAGE} THEN array(named_struct('type', 'text', 'text', text), "
            "named_struct('type', 'image_url', 'text', CAST(NULL AS STRING))) END"
        ).alias("parts"),
        F.expr(
            f"CASE WHEN role = 'assistant' THEN array(named_struct('id', concat('c', conv_id, '_', turn), 'name', {_CALL_NAME}, "
            "'args', map('path', concat('s', length(text) % 2, '.py')))) END"
        ).alias("tool_calls"),
        F.expr(_ANSWER).alias("tool_call_id"),
    )


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(load_table(spark, sf_dir, "conversations"))


DUCK = f"""m AS (SELECT conv_id, CAST(turn AS INT) AS seq, concat('m', conv_id, '_', turn) AS msg_id, {_TYPE} AS type, {_NAME} AS name, {_CONTENT} AS content,
    {_IMAGE} AS image, text AS raw, CASE WHEN role = 'assistant' THEN concat('c', conv_id, '_', turn) END AS call_id,
    CASE WHEN role = 'assistant' THEN {_CALL_NAME} END AS call_name,
    CASE WHEN role = 'assistant' THEN concat('s', length(text) % 2, '.py') END AS call_path, {_ANSWER} AS answer,
    CASE WHEN {_IMAGE} THEN length(text) ELSE coalesce(length({_CONTENT}), 0) END AS chars FROM conversations)"""

_DUCK_PARTS = "CASE WHEN image THEN 'text=' || raw || ';image_url=' END"
_DUCK_CALLS = "call_id || ':' || call_name || ':' || call_path"

_FLAT = {
    "parts": "array_join(transform(parts, p -> concat(p.type, '=', coalesce(p.text, ''))), ';')",
    "tool_calls": "array_join(transform(tool_calls, c -> concat(c.id, ':', c.name, ':', element_at(c.args, 'path'))), ';')",
}


def _flat(df: DataFrame) -> DataFrame:
    return df.select("conv_id", "seq", "type", "content", *[F.expr(sql).alias(n) for n, sql in _FLAT.items()])



# --------------------------------------------------------------- per conversation
@query(
    "conv_length",
    "SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS total_length FROM conversations GROUP BY conv_id",
)
def conv_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load_table(spark, sf_dir, "conversations")
    plain = turns.select(
        "conv_id", F.col("text").alias("content"), F.lit(None).cast("array<struct<type:string,text:string>>").alias("parts")
    )
    return cv.conversation_length(plain)


@query("conv_has_image", f"WITH {DUCK} SELECT conv_id, bool_or(image) AS has_image FROM m GROUP BY conv_id")
def conv_has_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.conversation_images(_messages(spark, sf_dir))


@query("last_ai", f"WITH {DUCK} SELECT conv_id, max(seq) FILTER (WHERE type = 'ai') AS last_ai FROM m GROUP BY conv_id")
def last_ai(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.last_ai(_messages(spark, sf_dir))


@query(
    "last_message",
    f"WITH {DUCK} SELECT conv_id, seq, type, content, {_DUCK_PARTS} AS parts FROM m QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY seq DESC) = 1",
)
def last_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.last_message(_messages(spark, sf_dir)).withColumn("parts", F.expr(_FLAT["parts"]))


ROUTE = f"""WITH {DUCK}, t AS (SELECT conv_id, CAST(sum(chars) AS BIGINT) AS total_length, bool_or(image) AS has_image FROM m GROUP BY conv_id)
    SELECT *, CASE WHEN has_image THEN 'multimodal' WHEN total_length > 2000 THEN 'remote' ELSE 'local' END AS route FROM t"""


@query("route_conversations", ROUTE)
def route_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.route_conversations(_messages(spark, sf_dir), threshold=2000)


_TOOLS = ["shell_run", "web_load_web_page", "web_readable_web_get", "web_other"]


@query(
    "gate_tools",
    f"""WITH {DUCK}, o AS (SELECT conv_id, coalesce(bool_or(name = 'web_load_web_page'), false) AS opened FROM m GROUP BY conv_id),
         t AS (SELECT conv_id, opened, unnest(['{"', '".join(_TOOLS)}']) AS tool FROM o)
       SELECT conv_id, tool FROM t WHERE opened OR NOT starts_with(tool, 'web_') OR tool = 'web_load_web_page'""",
)
def gate_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.gate_tools(_messages(spark, sf_dir), _TOOLS)


# --------------------------------------------------------------- calls
@query(
    "tool_call_log",
    f"""WITH {DUCK} SELECT conv_id, seq, 0 AS call_no, call_name AS name, '{{"path":"' || call_path || '"}}' AS input FROM m WHERE call_id IS NOT NULL""",
)
def tool_call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.tool_call_log(_messages(spark, sf_dir))


LATEST = f"""WITH {DUCK} SELECT conv_id, call_path AS key, seq, 0 AS call_no, call_id AS id FROM m WHERE call_name = 'create_python_script'
    QUALIFY row_number() OVER (PARTITION BY conv_id, call_path ORDER BY seq DESC) = 1"""


@query("latest_per_key", LATEST)
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.latest_calls(_messages(spark, sf_dir))


@query(
    "drop_superseded",
    f"""WITH {DUCK}, ranked AS (SELECT conv_id, call_id, row_number() OVER (PARTITION BY conv_id, call_path ORDER BY seq DESC) AS rn
              FROM m WHERE call_name = 'create_python_script'),
         hidden AS (SELECT conv_id, call_id FROM ranked WHERE rn > 1)
       SELECT m.conv_id, seq, type, content, CASE WHEN image THEN 'text=' || raw || ';image_url=' END AS parts,
              CASE WHEN m.call_id IS NULL THEN NULL WHEN h.call_id IS NOT NULL THEN '' ELSE m.call_id || ':' || call_name || ':' || call_path END AS tool_calls
       FROM m LEFT JOIN hidden h ON m.conv_id = h.conv_id AND m.call_id = h.call_id
       WHERE NOT (type = 'tool' AND EXISTS (SELECT 1 FROM hidden x WHERE x.conv_id = m.conv_id AND x.call_id = m.answer))
         AND NOT (h.call_id IS NOT NULL AND coalesce(content, '') = '')""",
)
def drop_superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(cv.drop_superseded(_messages(spark, sf_dir)))


# --------------------------------------------------------------- rewriting
@query(
    "stub_images",
    f"""WITH {DUCK}, l AS (SELECT conv_id, max(seq) FILTER (WHERE type = 'ai') AS last_ai FROM m GROUP BY conv_id)
       SELECT m.conv_id, seq, type, content,
              CASE WHEN image AND seq < last_ai THEN 'text=' || raw || ';text=[Image was analyzed in previous turn]'
                   WHEN image THEN 'text=' || raw || ';image_url=' END AS parts,
              CASE WHEN call_id IS NOT NULL THEN call_id || ':' || call_name || ':' || call_path END AS tool_calls
       FROM m JOIN l USING (conv_id)""",
)
def stub_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(cv.stub_images(_messages(spark, sf_dir)))


@query(
    "clear_tool_results",
    f"""WITH {DUCK}, o AS (SELECT conv_id, sum(ceil(chars / 4.0)) > 300 AS over FROM m GROUP BY conv_id),
         r AS (SELECT conv_id, seq, row_number() OVER (PARTITION BY conv_id ORDER BY seq DESC) <= 1 AS recent FROM m WHERE type = 'tool')
       SELECT m.conv_id, m.seq, type, CASE WHEN clear THEN '[cleared]' ELSE content END AS content,
              CASE WHEN image AND NOT clear THEN 'text=' || raw || ';image_url=' END AS parts,
              CASE WHEN call_id IS NOT NULL THEN call_id || ':' || call_name || ':' || call_path END AS tool_calls
       FROM (SELECT m.*, type = 'tool' AND over AND NOT coalesce(recent, false) AS clear FROM m JOIN o USING (conv_id) LEFT JOIN r ON r.conv_id = m.conv_id AND r.seq = m.seq) m""",
)
def clear_tool_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(cv.clear_tool_results(_messages(spark, sf_dir), trigger_tokens=300, keep=1))


@query(
    "summarise_split",
    f"""WITH {DUCK}, o AS (SELECT conv_id, sum(ceil(chars / 4.0)) > 500 AS over FROM m GROUP BY conv_id)
       SELECT conv_id, seq, over AND row_number() OVER (PARTITION BY conv_id ORDER BY seq DESC) > 2 AS summarised FROM m JOIN o USING (conv_id)""",
)
def summarise_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.summarise_split(_messages(spark, sf_dir), trigger_tokens=500, keep=2)


# turns t and t + 4 of a conversation share an id, so the later one replaces the earlier
UPSERT = f"""WITH {DUCK}, u AS (SELECT *, concat('m', conv_id, '_', seq % 4) AS id FROM m)
    SELECT conv_id, id AS msg_id, CAST(min(seq) OVER (PARTITION BY conv_id, id) AS INT) AS seq, type, name, content,
        {_DUCK_PARTS} AS parts, {_DUCK_CALLS} AS tool_calls, answer AS tool_call_id FROM u
    QUALIFY row_number() OVER (PARTITION BY conv_id, id ORDER BY u.seq DESC) = 1"""


def reused_ids(df: DataFrame) -> DataFrame:
    return df.withColumn("msg_id", F.expr("concat('m', conv_id, '_', seq % 4)"))


def all_columns(df: DataFrame) -> DataFrame:
    """Every column of keyed messages, lists as text."""
    return df.select(
        "conv_id", "msg_id", "seq", "type", "name", "content", *[F.expr(sql).alias(n) for n, sql in _FLAT.items()], "tool_call_id"
    )


@query("message_upsert", UPSERT)
def message_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reused_ids(_messages(spark, sf_dir))
    merged = cv.upsert_messages(rows.where("seq < 4"), rows.where("seq >= 4"))
    return all_columns(merged)


@query(
    "conversation_turn",
    f"""WITH {DUCK}, l AS (SELECT conv_id, max(seq) FILTER (WHERE type = 'ai') AS last_ai FROM m GROUP BY conv_id),
         ranked AS (SELECT conv_id, call_id, row_number() OVER (PARTITION BY conv_id, call_path ORDER BY seq DESC) AS rn FROM m WHERE call_name = 'create_python_script'),
         hidden AS (SELECT conv_id, call_id FROM ranked WHERE rn > 1),
         k AS (SELECT m.* FROM m LEFT JOIN hidden h ON m.conv_id = h.conv_id AND m.call_id = h.call_id
               WHERE NOT (type = 'tool' AND EXISTS (SELECT 1 FROM hidden x WHERE x.conv_id = m.conv_id AND x.call_id = m.answer))
                 AND NOT (h.call_id IS NOT NULL AND coalesce(content, '') = '')),
         l2 AS (SELECT conv_id, max(seq) FILTER (WHERE type = 'ai') AS last_ai FROM k GROUP BY conv_id),
         s AS (SELECT k.conv_id, k.chars + CASE WHEN image AND seq < last_ai THEN 37 ELSE 0 END AS chars, image AND NOT coalesce(seq < last_ai, false) AS image FROM k JOIN l2 USING (conv_id)),
         t AS (SELECT conv_id, CAST(sum(chars) AS BIGINT) AS total_length, bool_or(image) AS has_image FROM s GROUP BY conv_id)
       SELECT *, CASE WHEN has_image THEN 'multimodal' WHEN total_length > 2000 THEN 'remote' ELSE 'local' END AS route FROM t""",
)
def conversation_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps before a model call in their order: superseded calls, images, routing."""
    return cv.prepare_turn(_messages(spark, sf_dir), threshold=2000)
