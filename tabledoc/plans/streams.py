"""Streaming twins of the conversation queries, run over ``conversations`` as a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabledoc.plans import chats
from tabledoc.plans.registry import query
from tabledoc.session import load_table
from tabledoc.streaming import conversations as st


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema, top = load_table(spark, sf_dir, "conversations").schema, sf_dir.rstrip("/")
    # a stream takes a single file by a glob only; this one also fits a table that is a folder of files
    return chats.messages(st.message_stream(spark, f"{top}/conversations.parque[t]", schema, base=top))


@query("stream_upsert", chats.UPSERT)
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.all_columns(st.stream_upsert(chats.reused_ids(_stream(spark, sf_dir))))


@query("stream_latest", chats.LATEST)
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.stream_latest(_stream(spark, sf_dir))


@query("stream_route", chats.ROUTE)
def stream_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.stream_route(_stream(spark, sf_dir), threshold=2000)


@query(
    "stream_gate",
    f"WITH {chats.DUCK} SELECT conv_id, coalesce(bool_or(name = 'web_load_web_page'), false) AS opened FROM m GROUP BY conv_id",
)
def stream_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.stream_gate(_stream(spark, sf_dir))
