"""Vector, URL and chat operators and the pipeline against brute force, and their edge cases."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import check
import corpus_pipeline
from tabledoc.llm import chat_trees, embed_dedup, topk_voronoi, url_cascade
from tabledoc.llm.components import components
from tabledoc.llm.queries import QUERIES, RULES
from tabledoc.session import load_table, materialise


# --- search


def _best(rows, k, every):
    out = set()
    usable = [(i, [float(np.floor(64 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for i, v in usable:
        if i % every == 0:
            scores = sorted((-int(sum(a * b for a, b in zip(v, w))), j) for j, w in usable if j != i)
            out |= {(i, n, j, -s) for n, (s, j) in enumerate(scores[:k], 1)}
    return out


@pytest.mark.parametrize("pivots,part", [(1, 1000), (5, 7), (16, 3)])
def test_search_of_clusters_and_edge_rows(spark, pivots, part):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.05, 6) + 2 * (i % 4)]) for i in range(120)]
    rows += [(200, None), (220, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (240, [float("nan")] * 6), (260, [float("inf")] + [0.0] * 5), (None, [1.0] * 6)]
    rows += [(280, [0.5, 0.25]), (300, []), (301, [0.0] * 6), (302, rows[3][1])]
    data = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<float>, cell string")
    got = topk_voronoi.search(data, k=5, pivots=pivots, part_rows=part).collect()
    assert {tuple(r) for r in got} == _best(rows, 5, 20) and len(got) == len({tuple(r) for r in got})


def test_search_of_nothing_and_of_one(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert topk_voronoi.search(spark.createDataFrame([], schema)).count() == 0
    assert topk_voronoi.search(spark.createDataFrame([(20, [1.0])], schema)).count() == 0


# --- embedding near-duplicates


def _groups(rows, threshold):
    usable = [n for n, (i, v, g) in enumerate(rows) if i is not None and g is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, least = collections.Counter(), list(range(len(rows)))

    def root(n):
        while least[n] != n:
            n = least[n]
        return n

    for a in usable:
        for b in usable:
            if a < b and rows[a][2] == rows[b][2]:
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    links[a] += 1
                    links[b] += 1
                    p, q = root(a), root(b)
                    least[max(p, q)] = min(p, q)
    ids = collections.defaultdict(list)
    for n in usable:
        ids[root(n)].append(rows[n][0])
    out = []
    for n, (i, _, _) in enumerate(rows):
        component = min(ids[root(n)]) if n in usable else i
        out.append((i, links[n], component, None if i is None else i == component))
    return collections.Counter(out)


@pytest.mark.parametrize("block", [4, 64])
def test_embedding_groups(spark, block):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(80):
        centre = np.random.default_rng(i // 10).normal(0, 1, 8)
        v = centre + rng.normal(0, 0.07, 8) if i % 3 else centre
        rows.append((i, [float(np.float32(x)) for x in v], i // 40))
    rows += [rows[0], (90, [2 * x for x in rows[0][1]], 0), (91, None, 0), (92, [0.0] * 8, 0), (93, rows[0][1], None), (None, rows[0][1], 0)]
    rows += [(94, [float("nan")] + [0.0] * 7, 0), (95, [None] * 8, 0)]
    data = spark.createDataFrame([(i, v, g, 1) for i, v, g in rows], "vec_id bigint, embedding array<float>, label int, links int")
    got = embed_dedup.near_duplicates(data, block=block).collect()
    assert collections.Counter(tuple(r) for r in got) == _groups(rows, 0.98)
    assert embed_dedup.near_duplicates(data.limit(0)).count() == 0


def test_embedding_query(spark, sf_dir):
    rows = [tuple(r) for r in load_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label").collect()]
    got = QUERIES["op9_embedding_dedup"].build(spark, sf_dir).collect()
    assert collections.Counter(tuple(r) for r in got) == _groups(rows, 0.98)


def test_quantisation_bound_holds():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 40))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[30:] = x[:30] + rng.normal(0, 0.02, (30, 40))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = embed_dedup.quantise(x)
    for threshold in (0.9, 0.98, 0.999):
        a, b = embed_dedup.possible(q, q, threshold)
        assert set(zip(*np.nonzero(x @ x.T >= threshold))) <= set(zip(a, b))


def test_components(spark):
    random.seed(7)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + random.randint(1, 60)) for _ in range(50)] + [(300, 301), (301, 302), (302, 300), (5, 5)]
    got = dict(components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert all(got[i] == 0 for i in range(41)) and {got[300], got[301], got[302]} == {300}
    assert all(v == 100 for i, v in got.items() if 100 <= i < 200)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- URLs


def _judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else "allow"


def test_urls_of_edge_rows(spark):
    urls = [
        None, "", "example.com/en/", "://", "http://", "http://Example.COM/en/x?y#z", "https://www.example.com/en/", "http://notexample.com/en/",
        "http://a.example.net/es/1", "http://net/fr/", "http://net", "http://example.net?x=/es/", "http://com#", "http://com/", "ftp://x.y.z.net/es/a://b",
        "http://\u00c9.com/\u00e9", "http://example.com/en", "http://.com/", "http://a..net/es/", "http://example.com/en/x",
    ] + [f"http://h{i}.example.org/{i}" for i in range(200)]
    rows = spark.createDataFrame([(i, u, "old", 5) for i, u in enumerate(urls)], "page_id bigint, url string, host string, key int")
    out = url_cascade.judge(rows, RULES)
    assert out.columns == ["page_id", "url", "key", "host", "path", "rule", "verdict"]
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()} == {i: _judged(u) for i, u in enumerate(urls)}
    assert url_cascade.judge(rows.limit(0), RULES).count() == 0


def test_cascade_is_exact_on_its_universe(spark):
    every = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = every.where("hash(key) % 40 = 0")
    cascade = url_cascade.build_cascade(every, listed)
    h1, h2 = url_cascade.key_hashes(F.col("key"))
    got = every.select("key", h1.alias("h1"), h2.alias("h2")).toPandas()
    held = cascade.holds(got["h1"].to_numpy(), got["h2"].to_numpy())
    assert set(got["key"][held]) == {r[0] for r in listed.collect()}
    assert len(cascade.levels) >= 1 and url_cascade.build_cascade(every, listed.limit(0)).levels == []


# --- chats


def test_template_is_reversible(spark):
    random.seed(13)
    parts = ["<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "~", "~0", "~1", "~9", "<", "|", "\n", "a", "<|end|>", "<|turn|>", "\u00e9", "<<SYS>>", ">"]
    rows = [(i, 0, "".join(random.choices(parts, k=2)), "".join(random.choices(parts, k=random.randint(0, 12)))) for i in range(400)]
    data = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = chat_trees.format_trees(chat_trees.chain(data)).withColumn("back", chat_trees.read_turns(F.col("formatted")))
    assert {r["conv_id"]: [tuple(t) for t in r["back"]] for r in out.collect()} == {i: [(role, text)] for i, _, role, text in rows}


def test_best_branches_of_trees(spark):
    random.seed(14)
    rows, want = [], {}
    for t in range(12):
        parent, score = {0: None}, {0: random.random()}
        for n in range(1, 40):
            parent[n], score[n] = random.randrange(max(0, n - 4), n), random.random()
        rows += [(t, n, parent[n], random.choice(["user", "assistant"]), f"t{n}<|", score[n]) for n in parent]
        ranked = []
        for leaf in set(parent) - set(parent.values()):
            path, n = [], leaf
            while n is not None:
                path.append(n)
                n = parent[n]
            ranked.append((-sum(score[n] for n in path) / len(path), leaf, path[::-1]))
        want[t] = {leaf: path for _, leaf, path in sorted(ranked)[:2]}
    nodes = spark.createDataFrame(rows, "conv_id bigint, node bigint, parent bigint, role string, text string, s double")
    said = {(r[0], r[1]): r for r in rows}
    got = chat_trees.format_trees(nodes, score="s", branches=2)
    got = got.withColumns({"back": chat_trees.read_turns(F.col("formatted")), "loss": chat_trees.read_loss(F.col("formatted"), F.col("loss_spans"))}).collect()
    assert len(got) == 24
    for r in got:
        turns = [said[r["conv_id"], n] for n in want[r["conv_id"]][r["leaf"]]]
        assert [tuple(x) for x in r["back"]] == [(x[3], x[4]) for x in turns]
        assert r["loss"] == "".join(x[4] for x in turns if x[3] == "assistant") and r["n_turns"] == len(turns)


def test_chats_of_edge_rows(spark):
    rows = [(1, 1, "user", None), (1, 1, "user", None), (1, None, None, "first"), (None, 1, "assistant", "no id"), (2, 1, "assistant", "")]
    data = spark.createDataFrame([(*r, 3) for r in rows], "conv_id bigint, turn bigint, role string, text string, node int")
    out = chat_trees.format_trees(chat_trees.chain(data)).withColumn("back", chat_trees.read_turns(F.col("formatted")))
    got = {r["conv_id"]: [tuple(t) for t in r["back"]] for r in out.collect()}
    assert got == {1: [("", "first"), ("user", ""), ("user", "")], None: [("assistant", "no id")], 2: [("assistant", "")]}
    assert chat_trees.format_trees(chat_trees.chain(data.limit(0))).count() == 0
    circle = spark.createDataFrame([(1, 1, 2, "user", "a"), (1, 2, 1, "user", "b")], "conv_id bigint, node bigint, parent bigint, role string, text string")
    with pytest.raises(ValueError):
        chat_trees.format_trees(circle)
    lost = spark.createDataFrame([(1, 5, 4, "user", "a")], circle.schema)
    assert chat_trees.format_trees(lost).first()["n_turns"] == 1


def test_no_python_on_the_main_path_of_chats(spark, sf_dir):
    plan = QUERIES["op8_chat_format"].build(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- pipeline


def test_pipeline_stages(spark, sf_dir):
    docs = load_table(spark, sf_dir, "documents")
    columns, before = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
        kept = {r["doc_id"]: r for r in docs.collect()}
        assert set(kept) <= set(before) and len(kept) >= 0.6 * len(before), name
        if name == "secrets":
            assert set(kept) == set(before) and all(r["n_chars"] == len(r["text"]) for r in kept.values())
        else:
            assert all(kept[i] == before[i] for i in kept)
        before = kept
        docs = spark.createDataFrame(list(kept.values()), docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == set(before)


def test_pipeline_of_edge_rows(spark, sf_dir):
    schema = load_table(spark, sf_dir, "documents").schema
    for rows in ([], [(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "s", 0), (2, "the text of it", "en", "s", 14)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs.count()
            assert stage(spark, docs, sf_dir).count() <= len(rows)


def test_pipeline_keeps_columns_of_any_name(spark, sf_dir):
    names = "score predicted lang_pred rejected spans _base _tested _cells _doc_0 _own_0 component_id a.b".split()
    docs = load_table(spark, sf_dir, "documents").drop("n_chars")
    docs = docs.select("text", "lang", "doc_id", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = materialise(stage(spark, docs, sf_dir), f"test-{name}")
        assert made.columns == docs.columns
        assert made.count() and not made.where(" or ".join(f"`{n}` != concat('{n}', doc_id)" for n in names)).count()


def test_oracles_on_a_table_without_rows_to_spare(spark, sf_dir):
    con = check.connect(sf_dir)
    for name in ("op3_topk_search", "op7_url_filter", "op8_chat_format"):
        problem, _ = check.compare(spark, con, name, QUERIES[name].build, QUERIES[name].oracle, sf_dir)
        assert problem is None, (name, problem)
