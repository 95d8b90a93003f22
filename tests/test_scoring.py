"""Normalising, similarity, scores, runs and ordered operators."""

import random
import statistics
from difflib import SequenceMatcher
from os.path import basename
from urllib.parse import unquote, urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabledoc.functions.expressions import norm_string, slug, url_path
from tabledoc.functions.similarity import add_similarity, add_url_similarity, compared
from tabledoc.operators import ordered, quantiles
from tabledoc.operators import runs as rn
from tabledoc.operators import scoring as sc
from tabledoc.operators.tabular import asof_join, band_join
from tabledoc.sources import delimited as dl

HEAD = list(sc.EXPECTED_HEADERS)
HEAD_SCHEMA = ", ".join(f"`{h}` string" for h in HEAD)


def cards(spark, rows, columns=HEAD, numbered=False):
    fields = columns + (["row_no"] if numbered else [])
    rows = [tuple(r) + ((i,) if numbered else ()) for i, r in enumerate(rows)]
    schema = ", ".join(f"`{c}` {'int' if c == 'row_no' else 'string'}" for c in fields)
    return spark.createDataFrame(rows, schema)


ROW1 = ["core", "first", "1", "http://cards.example/s1.png", "かえる", "Frogs", "77", "May 2, 2001"]
ROW2 = ["core", "first", "2", "http://cards.example/s2.png", "うみ", "Sea", "31", "June 9, 2002"]
ROW3 = ["core", "first", "3", "http://cards.example/s3.png", "やま", "Hills", "12", "July 4, 2003"]


def final(spark, expected, actual, columns=HEAD):
    table = cards(spark, actual, columns, numbered=True)
    scores = sc.score_rows(cards(spark, expected), table)
    return sc.score_final(scores, sc.header_score(columns)).first(), scores


@pytest.mark.parametrize(
    "text, expected",
    [("Good Day", "good day"), ("Amber & Jade Era", "amber & jade"), ("AMBER & JADE ERA", "amber & jade"),
     ("  Many   Blanks  ", "many blanks"), ("\tTab\tthen\tLine\n", "tab then line"), ("", ""), (None, ""),
     ("camera", "cam"), ("a　b", "a b")],
)
def test_norm_string(spark, text, expected):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(norm_string("s")).first()[0] == expected


def test_slug(spark):
    df = spark.createDataFrame([("Main Sets (1996-1999)!",), ("Écran — total",)], "s string")
    assert [r[0] for r in df.select(slug("s")).collect()] == ["main_sets_1996_1999", "écran_total"]


def test_similarity_equals_difflib(spark):
    rng = random.Random(2)
    pairs = [("".join(rng.choice("abé ") for _ in range(rng.randint(0, 12))), "".join(rng.choice("abé ") for _ in range(rng.randint(0, 12)))) for _ in range(200)]
    pairs += [("Good Day", "good day"), ("Café de Nuit", "Cafe de Nuit Two"), ("かえるのうた", "かえる のうた"), ("", ""), ("a" * 300 + "b", "b" + "a" * 300)]
    df = add_similarity(spark.createDataFrame(pairs, "a string, b string"), {"s": ("a", "b")})
    for r in df.collect():
        a, b = (" ".join(x.split()).lower() for x in (r.a, r.b))
        assert r.s == pytest.approx(SequenceMatcher(None, a, b).ratio()), r


def test_url_similarity(spark):
    urls = ["", "http://h1.example/a/b/pic.png", "http://h2.example/other/pic.png", "http://h3.example/a/pic1.png",
            "http://h3.example/a%20long%20way/pic.png", "http://s.com/a b/c+d.png?x=1#f", "http://s.com/", "/rel/p;v=1", "http://s.com/%E3%83%9D.png"]
    pairs = [(a, b) for a in urls for b in urls]
    df = add_url_similarity(spark.createDataFrame(pairs, "a string, b string"), {"s": ("a", "b")})

    def expected(a, b):
        if not a or not b:
            return float(not a and not b)
        p, q = unquote(urlparse(a).path), unquote(urlparse(b).path)
        return 1.0 if basename(p) == basename(q) else SequenceMatcher(None, p.lower(), q.lower()).ratio()

    for r in df.collect():
        assert r.s == pytest.approx(expected(r.a, r.b)), r
    paths = spark.createDataFrame([(u,) for u in urls], "u string").select("u", url_path(F.col("u")).alias("p"))
    assert all(r.p == unquote(urlparse(r.u).path) for r in paths.collect())


def test_identical_tables(spark):
    row, _ = final(spark, [ROW1, ROW2], [ROW1, ROW2])
    assert row.final_score == pytest.approx(1.0) and row.success and row.matched_rows == 2


def test_missing_columns(spark):
    columns = ["Set", "Era", "Set No.", "Japanese Name"]
    row, _ = final(spark, [ROW1], [ROW1[:3] + [ROW1[4]]], columns)
    assert row.header_score == 0.0 and row.final_score <= 0.8
    assert sc.missing_headers(columns) == ["Symbol", "English Equivalent", "No. of Cards", "Release Date"]


def test_missing_rows(spark):
    row, scores = final(spark, [ROW1, ROW2, ROW3], [ROW1])
    assert row.avg_row_score == pytest.approx(1 / 3) and row.matched_rows == 1 and not row.success
    assert {r.column: (r.n, r.mean_score) for r in sc.score_columns(scores).collect()}["Symbol"] == (1, 1.0)


def test_key_normalising_and_last_wins(spark):
    actual = [["Core Era", "First Era", "  1  ", *ROW1[3:4], "zzz", *ROW1[5:]], ["CORE", "first", "1", *ROW1[3:]]]
    row, _ = final(spark, [ROW1], actual)
    assert row.final_score == pytest.approx(1.0)
    row, _ = final(spark, [ROW1], actual[::-1])
    assert row.final_score < 1.0


def test_no_expected_rows(spark):
    row, scores = final(spark, [], [ROW1])
    assert row.success and row.final_score == 1.0
    report = {r.item: r.value for r in sc.score_report(scores, 1.0).collect()}
    assert report["final_score"] == 1.0 and report["total_rows"] == 0
    assert sc.failure(spark, "output_csv_missing").first().asDict() == {"success": False, "error": "output_csv_missing"}


def test_runs(spark):
    runs = spark.createDataFrame(
        [("m/1", "b1", 1, True, 2.0, None, {"final_score": 0.954}), ("m/1", "b1", 2, False, 4.0, "timeout", None),
         ("m/1", "b1", 3, True, 6.0, None, {"final_score": 1.0}), ("m2", "b2", 1, True, 5.0, None, {"other": 1.0})],
        rn.RUN_SCHEMA,
    )
    by = {(r.model, r.benchmark): r for r in rn.run_summary(runs).collect()}
    assert by[("m/1", "b1")].std_duration == statistics.stdev([2, 4, 6]) and by[("m2", "b2")].std_duration == 0.0
    assert by[(None, None)].runs == 4 and not by[(None, None)].all_passed and by[("m2", None)].all_passed
    assert {r.model: r.avg_score for r in rn.run_scores(runs).collect()} == {"m/1": pytest.approx(0.977), "m2": None}
    assert [r.scores for r in rn.run_score_list(runs).collect()] == ["1=0.95, 3=1.00"]
    paged = rn.run_score_list(runs, page=1, width=2).orderBy("page_no").collect()
    assert [(r.page_no, r.scores) for r in paged] == [(0, "1=0.95"), (2, "3=1.00")]


@pytest.fixture(scope="module")
def hot(spark):
    """Half of the rows have one key; ids have gaps; some keys are NULL."""
    rng = random.Random(4)
    rows = [(i * rng.randint(1, 3) + i * 3, None if i % 19 == 0 else 0 if i % 2 else i % 7, float(rng.randint(-9, 9))) for i in range(400)]
    ids = {}
    for r in rows:
        ids[r[0]] = r
    return spark.createDataFrame(list(ids.values()), "id bigint, k int, v double")


def test_bounded_windows_equal_plain_ones(spark, hot):
    hot.createOrReplaceTempView("hot")
    plain = {r.id: r for r in spark.sql("""SELECT id, row_number() OVER w AS n, sum(v) OVER w AS s, lag(v, 2) OVER w AS p, lead(v) OVER w AS q,
        avg(v) OVER (PARTITION BY k ORDER BY id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS m,
        rank() OVER x AS r, dense_rank() OVER x AS d, percent_rank() OVER x AS pr, cume_dist() OVER x AS cd
        FROM hot WINDOW w AS (PARTITION BY k ORDER BY id), x AS (PARTITION BY k ORDER BY v)""").collect()}
    for width in (7, 64, 1 << 20):
        for r in ordered.numbered(hot, ["k"], "id", width).collect():
            assert r.idx == plain[r.id].n
        for r in ordered.running_sum(hot, ["k"], "id", "v", width).collect():
            assert r.running == plain[r.id].s
        got = ordered.framed(hot, ["k"], "id", {
            "p": lambda w: F.lag("v", 2).over(w), "q": lambda w: F.lead("v").over(w), "m": lambda w: F.avg("v").over(w.rowsBetween(-2, 1)),
        }, before=2, after=1, width=width).collect()
        assert len(got) == len(plain)
        for r in got:
            assert (r.p, r.q, r.m) == (plain[r.id].p, plain[r.id].q, plain[r.id].m)
    for step in (0.5, 5.0, 100.0):
        got = ordered.ranked(hot, ["k"], "v", step).collect()
        assert len(got) == len(plain)
        for r in got:
            e = plain[r.id]
            assert (r.rank, r.dense_rank) == (e.r, e.d) and r.percent_rank == pytest.approx(e.pr) and r.cume_dist == pytest.approx(e.cd)


def test_sparse_ids_fill_bounded_buckets(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BUCKET_ROWS", 50)
    # one hot key, ids spread over all 64 bits
    df = spark.range(1000).selectExpr("xxhash64(id) AS id", "CAST(if(id % 3 = 0, id % 5, 0) AS int) AS k", "CAST(id AS double) AS v")
    sizes = ordered.bucketed(df, "id").groupBy("_bucket").count().toPandas()["count"]
    assert len(sizes) >= 15 and sizes.max() <= 75
    df.createOrReplaceTempView("sparse")
    want = spark.sql("SELECT id, row_number() OVER w AS n, sum(v) OVER w AS s, lag(v) OVER w AS p FROM sparse WINDOW w AS (PARTITION BY k ORDER BY id)")
    got = ordered.framed(df, ["k"], "id", {"p": lambda w: F.lag("v").over(w)}, before=1, running={"s": "v"})
    assert sorted(map(tuple, got.select("id", "s", "p").collect())) == sorted(map(tuple, want.select("id", "s", "p").collect()))


def _numbers(df, rows, order):
    """Row numbers and running sums of a plain window, as a bag."""
    df.createOrReplaceTempView("plain")
    return sorted(map(tuple, df.sparkSession.sql(
        f"SELECT {rows}, row_number() OVER w AS n, sum(v) OVER w AS s FROM plain WINDOW w AS (PARTITION BY k ORDER BY {order})"
    ).collect()))


def test_an_outlying_id_leaves_buckets_bounded(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BUCKET_ROWS", 100)
    df = spark.range(2000).selectExpr("if(id = 1999, 1L << 62, id) AS id", "0 AS k", "id % 7 AS v")
    sizes = ordered.bucketed(df, "id").groupBy("_bucket").count().toPandas()["count"]
    assert sizes.max() <= 150 and sizes.sum() == 2000
    got = ordered.numbered(df, ["k"], "id", running={"s": "v"}).select("id", "idx", "s")
    assert sorted(map(tuple, got.collect())) == _numbers(df, "id", "id")


def test_equal_values_are_cut_by_their_tie(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BUCKET_ROWS", 100)
    # 5 on half of the rows, null on a fifth, the others spread
    df = spark.range(1500).selectExpr(
        "id", "id % 2 AS k", "CASE WHEN id % 10 < 5 THEN 5 WHEN id % 10 < 7 THEN NULL ELSE id END AS o", "id % 11 AS v"
    )
    cut = ordered.bucketed(df, "o", tie="id")
    sizes = cut.groupBy("_bucket").count().toPandas()["count"]
    assert sizes.max() <= 151 and sizes.sum() == 1500
    assert ordered.bucketed(df, "o").groupBy("_bucket").count().toPandas()["count"].max() >= 750
    got = ordered.numbered(df, ["k"], "o", running={"s": "v"}, tie="id").select("id", "idx", "s")
    assert sorted(map(tuple, got.collect())) == _numbers(df, "id", "o, id")


def test_ranks_in_small_buckets(spark, hot, monkeypatch):
    monkeypatch.setattr(ordered, "BUCKET_ROWS", 5)
    hot.createOrReplaceTempView("hot")
    want = spark.sql("""SELECT id, rank() OVER x AS r, dense_rank() OVER x AS d, cume_dist() OVER x AS c
        FROM hot WINDOW x AS (PARTITION BY k ORDER BY v)""")
    got = ordered.ranked(hot, ["k"], "v").select("id", "rank", "dense_rank", "cume_dist")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_quantiles_by_selection(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BUCKET_ROWS", 40)
    rng = random.Random(21)
    rows = [(None if i % 13 == 0 else 0 if i % 3 else i % 5, None if i % 11 == 0 else rng.choice([rng.random() * 100, 5.0, -1e9, float(i)])) for i in range(1500)]
    rows += [(9, None), (8, 2.5)]
    shares = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = quantiles.exact_quantiles(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", shares)
    plan = got._jdf.queryExecution().toString()
    assert "percentile" not in plan
    want = {}
    for k in {k for k, _ in rows}:
        values = sorted(v for key, v in rows if key == k and v is not None)
        if values:
            want[k] = [pytest.approx(float(np.quantile(values, s)), abs=1e-6, rel=1e-12) for s in shares.values()]
    assert {r.k: list(r)[1:] for r in got.collect()} == want


@pytest.mark.parametrize("bucket", ["_at div 5", "_at div 50", "_at div 100000"])
def test_asof_equals_brute_force(spark, bucket):
    rng = random.Random(8)
    left = [(i, None if i % 17 == 0 else rng.choice([0, 0, 0, 1, 2]), rng.randint(0, 300)) for i in range(120)]
    right = [(rng.choice([0, 0, 1, None]), t, f"r{t}") for t in rng.sample(range(300), 90)]
    got = asof_join(
        spark.createDataFrame(left, "id int, k int, t bigint"), spark.createDataFrame(right, "k int, rt bigint, val string"),
        ["k"], "t", "rt", ["val"], bucket,
    ).collect()
    assert len(got) == len(left)
    for r in got:
        before = [(t, v) for k, t, v in right if k is not None and k == r.k and t <= r.t]
        assert r.val == (max(before)[1] if before else None)


def test_band_join_equals_brute_force(spark):
    rng = random.Random(9)
    bands = [(i, a := rng.randint(-50, 50) / 2, a + rng.randint(0, 30) / 4) for i in range(40)]
    points = [(i, rng.randint(-100, 100) / 4) for i in range(150)]
    got = band_join(
        spark.createDataFrame(bands, "b int, low double, high double"), spark.createDataFrame(points, "p int, x double"), "low", "high", "x", 3.0
    ).collect()
    want = sorted((b, p) for b, lo, hi in bands for p, x in points if lo <= x < hi)
    assert sorted((r.b, r.p) for r in got) == want


def test_only_open_pairs_are_compared_and_once(spark):
    rows = [("s", "e", str(i), f"http://a/{i}.png", "same" if i % 2 else "open text", "x", "3", "d") for i in range(40)]
    expected = spark.createDataFrame(rows, HEAD_SCHEMA)
    actual = spark.createDataFrame([(*r[:4], r[4].replace("open", "OPEN of the"), "", *r[6:]) for r in rows], HEAD_SCHEMA).withColumn("row_no", F.lit(1))
    scores = sc.score_rows(expected, actual)
    assert {(r.s0, r.s1, r.s2, r.s3, r.s4) for r in scores.collect()} == {
        (1.0, s, 0.0, 1.0, 1.0) for s in (1.0, SequenceMatcher(None, "open text", "open of the text").ratio())
    }
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    pairs = spark.createDataFrame([("open text", "open of the text"), ("open text", "open of the text")], "a string, b string")
    assert compared(pairs).count() == 1


def test_outcomes_of_outputs(spark, tmp_path):
    rows = [("s", "e", str(i), f"http://a/{i}.png", f"n{i}", "x", "3", "d") for i in range(3)]
    expected = spark.createDataFrame(rows, HEAD_SCHEMA)
    missing = sc.score_output(expected, str(tmp_path / "none.csv")).first()
    assert (missing.success, missing.error, missing.final_score) == (False, "output_csv_missing", None)
    place = tmp_path / "out.csv"
    lines = [";".join(HEAD)] + [";".join(r) for r in rows]
    # the key of the first row once more, with other values: the last row counts
    place.write_text("\n".join([lines[0], lines[1].replace("n0", "zzz"), *lines[1:]]) + "\n")
    whole = sc.score_output(expected, str(place)).first()
    assert (whole.success, whole.error, whole.total_rows, whole.header_score, whole.final_score) == (True, None, 3, 1.0, 1.0)
    assert sc.score_output(expected.limit(0), str(place)).first().final_score == 1.0
    place.write_text("")
    empty = sc.score_output(expected, str(place)).first()
    assert (empty.success, empty.matched_rows, empty.header_score, empty.final_score) == (False, 0, 0.0, 0.0)
    place.write_text("Set;Era;Set No.;Japanese Name\ns;e;1;n1\n")
    partial = sc.score_output(expected, str(place)).first()
    assert (partial.header_score, partial.matched_rows) == (0.0, 1)
    assert [r.name for r in sc.missing_names(dl.header_cells(spark, str(place))).orderBy("position").collect()] == ["Symbol", "English Equivalent", "No. of Cards", "Release Date"]
