"""Conversation operators and their streaming twins."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from tabledoc.operators import conversations as cv
from tabledoc.streaming import conversations as st


def msg(seq, kind, content="t", name=None, parts=None, calls=None, answer=None, conv=1, mid=None):
    calls = calls and [(i, n, {"path": p} if p else {}) for i, n, p in calls]
    return (conv, seq, mid or f"m{seq}", kind, name, content, parts, calls, answer)


@pytest.fixture(scope="session")
def messages_of(spark):
    return lambda *rows: spark.createDataFrame(list(rows), cv.MESSAGE_SCHEMA)


TOOL = cv.SUPERSEDED_TOOL


def test_drop_superseded(messages_of):
    rows = messages_of(
        msg(0, "human"),
        msg(1, "ai", "first", calls=[("call_1", TOOL, "a.py")]), msg(2, "tool", answer="call_1"),
        msg(3, "ai", "", calls=[("call_2", TOOL, "a.py")]), msg(4, "tool", answer="call_2"),
        msg(5, "ai", "", calls=[("call_3", TOOL, "a.py"), ("call_x", "other", "a.py")]), msg(6, "tool", answer="call_3"),
        msg(7, "ai", "", calls=[("call_4", TOOL, "b.py")]), msg(8, "tool", answer="call_4"),
        msg(9, "tool", "t", answer=None),
        msg(10, "ai", "", calls=[("call_5", TOOL, None)]),
        msg(1, "ai", "", calls=[("call_1", TOOL, "a.py")], conv=2),
    )
    got = {(r.conv_id, r.seq): [c.id for c in r.tool_calls or []] for r in cv.drop_superseded(rows).collect()}
    assert got == {
        (1, 0): [], (1, 1): [], (1, 5): ["call_3", "call_x"], (1, 6): [], (1, 7): ["call_4"], (1, 8): [], (1, 9): [],
        (1, 10): ["call_5"], (2, 1): ["call_1"],
    }


def _without_superseded(rows):
    """By loops: messages of (conv, seq, type, content, calls, answer) as (conv, seq, call ids)."""
    latest, out = {}, []
    for c, seq, _, _, calls, _ in rows:
        for no, (cid, name, path) in enumerate(calls or []):
            if name == TOOL and path:
                latest[c, path] = max(latest.get((c, path), (-1, -1)), (seq, no))
    hidden = {(c, seq, no): cid for c, seq, _, _, calls, _ in rows for no, (cid, name, path) in enumerate(calls or []) if name == TOOL and path and latest[c, path] != (seq, no)}
    gone = {(c, cid) for (c, _, _), cid in hidden.items()}
    for c, seq, kind, content, calls, answer in rows:
        if kind == "tool" and (c, answer) in gone:
            continue
        left = [cid for no, (cid, _, _) in enumerate(calls or []) if (c, seq, no) not in hidden]
        if calls and len(left) < len(calls) and not left and not content:
            continue
        out.append((c, seq, tuple(left)))
    return sorted(out)


def test_superseded_calls_equal_loops_in_two_scans(messages_of, tmp_path):
    rng = random.Random(41)
    plain = []
    for c in range(12):
        for seq in range(rng.randint(1, 25)):
            kind = rng.choice(["ai", "ai", "human", "tool"])
            calls = [(f"c{c}_{seq}_{n}", rng.choice([TOOL, TOOL, "other"]), rng.choice(["a.py", "b.py", None])) for n in range(rng.randint(0, 3))] if kind == "ai" else None
            known = [x[0] for p in plain if p[0] == c for x in p[4] or []]
            plain.append((c, seq, kind, rng.choice(["", "t"]), calls, rng.choice(known) if kind == "tool" and known else None))
    rows = messages_of(*[msg(seq, kind, content, calls=calls, answer=answer, conv=c) for c, seq, kind, content, calls, answer in plain])
    path = str(tmp_path / "m")
    rows.write.parquet(path)
    rows = rows.sparkSession.read.schema(rows.schema).parquet(path)
    kept = cv.drop_superseded(rows)
    want = _without_superseded(plain)
    assert sorted((r.conv_id, r.seq, tuple(x.id for x in r.tool_calls or [])) for r in kept.collect()) == want
    whole = cv.route_conversations(cv.stub_images(kept), 10).orderBy("conv_id").collect()
    assert cv.prepare_turn(rows, 10).orderBy("conv_id").collect() == whole
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation")
    assert scans(kept) == 2 and scans(cv.prepare_turn(rows)) == 3


def test_images_and_route(messages_of):
    image = [("text", "see"), ("image_url", None)]
    rows = messages_of(
        msg(0, "human", None, parts=image), msg(1, "ai", "ok"), msg(2, "human", None, parts=image),
        msg(0, "human", "x" * 10, conv=2), msg(0, "human", "x" * 11, conv=3), msg(0, "human", None, parts=image, conv=4),
    )
    stubbed = {(r.conv_id, r.seq): [p.type for p in r.parts] for r in cv.stub_images(rows).where("parts IS NOT NULL").collect()}
    assert stubbed == {(1, 0): ["text", "text"], (1, 2): ["text", "image_url"], (4, 0): ["text", "image_url"]}
    assert cv.stub_images(rows).where("conv_id = 1 AND seq = 0").first().parts[1].text == cv.IMAGE_STUB
    routes = {r.conv_id: r.route for r in cv.route_conversations(rows, threshold=10).collect()}
    assert routes == {1: "multimodal", 2: "local", 3: "remote", 4: "multimodal"}
    assert {r.route for r in cv.route_conversations(rows, 10, multimodal=False).collect()} == {"local", "remote"}


def test_gate(messages_of):
    tools = ["shell_run", "web_load_web_page", "web_readable_web_get", "web_other"]
    rows = messages_of(msg(0, "human"), msg(0, "tool", name="web_load_web_page", conv=2))
    got = cv.gate_tools(rows, tools).groupBy("conv_id").agg(F.sort_array(F.collect_list("tool")).alias("t"))
    assert {r.conv_id: r.t for r in got.collect()} == {1: tools[:2], 2: sorted(tools)}


def test_clear_and_split(messages_of):
    rows = messages_of(
        *[msg(i, "tool" if i % 2 else "ai", "x" * 40) for i in range(10)], msg(0, "tool", "x" * 40, conv=2)
    )
    cleared = cv.clear_tool_results(rows, trigger_tokens=50, keep=3).where("content = '[cleared]'")
    assert sorted((r.conv_id, r.seq) for r in cleared.collect()) == [(1, 1), (1, 3)]
    assert cv.clear_tool_results(rows, trigger_tokens=100).where("content = '[cleared]'").count() == 0
    split = cv.summarise_split(rows, trigger_tokens=50, keep=5).where("summarised")
    assert sorted((r.conv_id, r.seq) for r in split.collect()) == [(1, i) for i in range(5)]


def test_rank_limit_before_the_exchange(messages_of):
    plan = cv.last_k(messages_of(msg(0, "ai")), 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_upsert_and_last(messages_of):
    old = messages_of(msg(0, "human", "a", mid="x"), msg(1, "ai", "b", mid="y"))
    new = messages_of(msg(2, "human", "c", mid="x"), msg(3, "ai", "d", mid="z"))
    merged = cv.upsert_messages(old, new).orderBy("seq").collect()
    assert [(r.seq, r.msg_id, r.content) for r in merged] == [(0, "x", "c"), (1, "y", "b"), (3, "z", "d")]
    assert cv.last_message(old.unionByName(new)).first().content == "d"


def test_call_log(messages_of):
    row = cv.tool_call_log(messages_of(msg(0, "ai", calls=[("c", "f", "p.py")]))).first()
    assert (row.name, row.input) == ("f", '{"path":"p.py"}')


def test_streams_equal_batch_over_several_files(spark, messages_of, tmp_path):
    """State carried over micro-batches gives the batch result."""
    image = [("text", "see"), ("image", None)]
    rows = messages_of(
        *[msg(i, "ai" if i % 2 else "human", "x" * i, mid=f"m{i % 5}", conv=c, name="web_load_web_page" if c == i == 3 else None,
              calls=[(f"c{c}_{i}", TOOL, f"{i % 3}.py")] if i % 2 else None, parts=image if c == 2 and i == 4 else None)
          for c in range(1, 6) for i in range(12)]
    )
    place = str(tmp_path / "in")
    for part in range(3):
        rows.where(F.col("seq") % 3 == part).coalesce(1).write.mode("append").parquet(place)

    def stream():
        return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(place)

    def same(a, b):
        columns = sorted(a.columns)
        assert sorted(map(str, a.select(columns).collect())) == sorted(map(str, b.select(columns).collect()))

    same(st.stream_route(stream(), threshold=60), cv.route_conversations(rows, threshold=60))
    same(st.stream_latest(stream()), cv.latest_calls(rows))
    opened = rows.groupBy("conv_id").agg(F.bool_or(F.coalesce(F.col("name") == cv.GATE_OPENER, F.lit(False))).alias("opened"))
    same(st.stream_gate(stream()), opened)
    merged = cv.upsert_messages(rows.where("seq < 0"), rows)
    same(st.stream_upsert(stream()), merged)


def _bag(df, *columns):
    return sorted(map(str, df.select(*(columns or sorted(df.columns))).collect()))


def test_a_sink_equals_the_state_over_restarts(spark, tmp_path):
    """Batches in three runs, one publication that breaks off, one that is repeated."""
    schema = "conv_id bigint, name string, content string, parts array<struct<type:string,text:string>>"
    place, out, source = (str(tmp_path / n) for n in ("checkpoint", "sink", "in"))
    said = []

    def add(*rows):
        said.extend(rows)
        spark.createDataFrame([(c, None, t, None) for c, t in rows], schema).coalesce(1).write.mode("append").parquet(source)

    def stream():
        return st.route_state(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))

    def same():
        got = {r.conv_id: r.v0 for r in st.read_latest(spark, out, "conv_id").collect()}
        assert got == {r.conv_id: r.v0 for r in st.read_state(spark, place).collect()}
        assert got == {c: sum(len(t) for d, t in said if c == d) for c, _ in said}

    add((1, "aa"), (2, "b"))
    add((1, "ccc"))
    st.run(stream(), place)
    assert st.publish(spark, place, out) == 1
    same()
    changes = [tuple(r) for r in st.updates(spark, place).select("batch_id", "conv_id", "v0", "removed").collect()]
    assert sorted(changes) == [(0, 1, 2, False), (0, 2, 1, False), (1, 1, 5, False)]
    add((2, "dddd"), (3, "e"))
    st.run(stream(), place)
    # rows without a commit, as of a run that broke off, are not read
    st.updates(spark, place, 2, 2).withColumn("v0", F.lit(-1).cast("bigint")).write.parquet(f"{out}/rows/upto=2")
    assert {r.conv_id: r.v0 for r in st.read_latest(spark, out, "conv_id").collect()} == {1: 5, 2: 1}
    assert st.publish(spark, place, out) == st.publish(spark, place, out) == 2
    same()
    add((3, "ff"))
    st.run(stream(), place)
    st.run(stream(), place)
    assert st.publish(spark, place, out) == 3
    same()


def test_state_expires(spark, tmp_path):
    schema = "conv_id bigint, name string, content string, parts array<struct<type:string,text:string>>, at timestamp"
    places = {"place": str(tmp_path / "checkpoint"), "out": str(tmp_path / "sink")}
    source = str(tmp_path / "in")

    def add(*rows):
        df = spark.createDataFrame([(c, cv.GATE_OPENER, t, None, None) for c, t, _ in rows], schema).drop("at")
        stamps = spark.createDataFrame([(c, t, m) for c, t, m in rows], "conv_id bigint, content string, m int")
        df = df.join(stamps, ["conv_id", "content"]).select(
            "conv_id", "name", "content", "parts", F.timestamp_seconds(F.col("m") * 60).alias("at")
        )
        df.coalesce(1).write.mode("append").parquet(source)

    def routes():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        return {r.conv_id: r.total_length for r in st.stream_route(stream, expire=("at", "10 minutes"), **places).collect()}

    add((1, "aa", 1), (2, "b", 12))
    assert routes() == {1: 2, 2: 1}
    add((2, "ccc", 41))
    add((3, "d", 42))
    assert routes() == {2: 3, 3: 1}
    assert st.read_state(spark, places["place"]).count() == 2


_TURNS = [
    (c, t, "system" if t < 0 else "assistant" if t % 2 else "user", "x" * n)
    for c, *lengths in ((1, 4, 12, 10, 7, 8, 3), (2, 7, 9, 2, 16), (3, 2500, 5, 6), (4, 40))
    for t, n in enumerate(lengths, -1 if c == 3 else 0)
]


@pytest.mark.parametrize("layout", ["file", "files", "partitions"])
@pytest.mark.parametrize("name", ["stream_gate", "stream_latest", "stream_route", "stream_upsert"])
def test_stream_over_any_layout_of_the_table(spark, tmp_path, name, layout):
    """A table is one file, a folder of files or a folder of partitions; other tables lie beside it."""
    turns = spark.createDataFrame(_TURNS, "conv_id bigint, turn bigint, role string, text string")
    place = f"{tmp_path}/conversations.parquet"
    turns.limit(3).write.parquet(f"{tmp_path}/others.parquet")
    if layout == "file":
        turns.coalesce(1).write.parquet(f"{tmp_path}/of")
        next((tmp_path / "of").glob("part-*")).rename(place)
    else:
        turns.repartition(3).write.partitionBy(*["role"] * (layout == "partitions")).parquet(place)
    got = queries()[name](spark, str(tmp_path))
    with duckdb.connect() as db:
        db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
        db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", _TURNS)
        want = db.sql(oracle_sql()[name])
        assert Counter(map(tuple, got.select(want.columns).collect())) == Counter(want.fetchall())
