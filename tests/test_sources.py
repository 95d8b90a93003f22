"""Delimited files, decoding, listings, images, entries, SQL passage, sinks."""

import datetime
import decimal

import pytest
from pyspark.sql import functions as F

from tabledoc.operators.tabular import describe, normalise_values
from tabledoc.plans import scores
from tabledoc.plans.sql_passage import bounded_query, run_query
from tabledoc.session import checkpoint_root, materialise
from tabledoc.sources import delimited as dl
from tabledoc.sources import entries as en
from tabledoc.sources import files as fl
from tabledoc.sources import sinks


@pytest.fixture
def put(tmp_path):
    def write(name, content):
        path = tmp_path / name
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
        return str(path)

    return write


def test_rows(spark, put):
    path = put("a.csv", 'a,b,c\n1,2,3\n4\n\n6,7,8,9\n"x, ""y""",,""\n')
    df = dl.read_delimited(spark, path)
    assert df.columns == ["a", "b", "c", "column3"] and {t for _, t in df.dtypes} == {"string"}
    assert [tuple(r) for r in df.collect()] == [
        ("1", "2", "3", None), ("4", None, None, None), ("6", "7", "8", "9"), ('x, "y"', None, None, None)
    ]


def test_quoted_newline_and_names(spark, put):
    path = put("b.csv", 'a,A,\n"1\n2",3,4\n')
    df = dl.read_delimited(spark, path, multiline=True)
    assert df.columns == ["a", "A_1", "column2"] and tuple(df.first()) == ("1\n2", "3", "4")
    assert dl.read_delimited(spark, put("c.csv", "1,2\n"), header=False).columns == ["column0", "column1"]


@pytest.mark.parametrize(
    "content, delimiter, quote, header",
    [("a,b\n1,2\n3,4\n", ",", '"', True), ("a;b\n1,5;2\n3,4;x\n", ";", '"', True), ("a\tb\nx\ty\n", "\t", '"', True),
     ("a|b\nx|1\ny|2\n", "|", '"', True), ("1,2\n3,4\n", ",", '"', False), ("name\nx\ny\n", ",", '"', True), ("", ",", '"', True),
     ("a,b\n'x,y','2'\n'z,w','3'\n", ",", "'", True), ('a,b\n"x;y;z",2\n"p;q;r",3\n', ",", '"', True)],
)
def test_dialect(spark, put, content, delimiter, quote, header):
    row = dl.csv_dialects(spark, [put("d.csv", content)]).first()
    assert (row.delimiter, row.quote, row.has_header) == (delimiter, quote, header)


def test_load_and_query(spark, put):
    path = put("e.csv", "k;v\na;1\nb;2\na;3\n")
    table, entry = dl.load_delimited(spark, path)
    row = entry.first()
    assert (row.rows, row.columns, row.column_names, row.delimiter, row.file_size_bytes) == (3, 2, "k, v", ";", 16)
    result = run_query(spark, row.data_id, f" SELECT k, sum(CAST(v AS DECIMAL(9, 1))) AS s FROM {row.data_id} GROUP BY k ORDER BY k DESC; ")
    assert result.row_count == 2 and [tuple(r) for r in result.stored.collect()] == [("b", 2.0), ("a", 4.0)]
    again = run_query(spark, row.data_id, result.sql)
    assert result.result_id == again.result_id and result.result_id.startswith("csv_query_")


def test_caps_and_rejections(spark):
    spark.range(1500).createOrReplaceTempView("many")
    for keep in (True, False):
        result = run_query(spark, "many", "SELECT id FROM many ORDER BY id DESC", keep=keep)
        assert result.row_count == 1500 and result.stored.count() == 1000
        assert [r.id for r in result.display.collect()] == list(range(1499, 1479, -1))
    for bad in ("  ; ", "DROP VIEW many", "INSERT INTO many VALUES (1)", "SELECT 1; SELECT 2", "CREATE VIEW q AS SELECT 1"):
        with pytest.raises(Exception):
            bounded_query(spark, bad).collect()
    assert bounded_query(spark, "WITH a AS (SELECT 1 AS x) SELECT x FROM a -- note").first().x == 1


def test_normalise(spark):
    stamp = datetime.datetime(2024, 1, 2, 3, 4, 5)
    df = spark.createDataFrame(
        [(1, 1.5, "s", True, decimal.Decimal("2.50"), stamp, stamp.replace(microsecond=7), stamp.date(), [1, 2], None)],
        "i int, f double, s string, b boolean, d decimal(9,2), t timestamp, u timestamp_ntz, y date, a array<int>, n decimal(5,1)",
    )
    assert tuple(normalise_values(df).first()) == (
        1, 1.5, "s", True, 2.5, "2024-01-02T03:04:05", "2024-01-02T03:04:05.000007", "2024-01-02", "[1,2]", None
    )
    assert [tuple(r) for r in describe(df.select("i", "t")).collect()] == [(0, "i", "int", 1), (1, "t", "timestamp", 1)]


def test_decode(spark):
    texts = ["plain", "é漢", "naïve café", "“quoted” – €5"]
    rows = [(t.encode("utf-8"), t) for t in texts] + [(t.encode("cp1252"), t) for t in texts if "漢" not in t]
    df = spark.createDataFrame(rows, "c binary, t string").select(fl.decode_bytes("c").alias("d"), "t")
    assert all(r.d == r.t for r in df.collect())


def test_listing(spark, tmp_path):
    (tmp_path / "sub" / "deep").mkdir(parents=True)
    for name, size in (("a.txt", 3), ("b.txt", 1), ("sub/c.txt", 5), ("sub/deep/d.txt", 7)):
        (tmp_path / name).write_bytes(b"x" * size)
    flat = sorted(tuple(r) for r in fl.list_files(spark, str(tmp_path)).collect())
    assert flat == [("dir", "sub", 12), ("file", "a.txt", 3), ("file", "b.txt", 1)]
    deep = sorted(tuple(r) for r in fl.list_files(spark, str(tmp_path), recursive=True).collect())
    assert deep[:2] == [("dir", "sub", 12), ("dir", "sub/deep", 7)] and len(deep) == 6


def test_images(spark, tmp_path):
    for name in ("a.PNG", "b.jpg", "c.tiff2"):
        (tmp_path / name).write_bytes(bytes(range(256)) * 4)
    rows = {r.path[-5:]: r for r in fl.ingest_images(fl.read_binary(spark, str(tmp_path))).collect()}
    import base64

    assert rows["a.PNG"].mime_type == "image/png" and rows["b.jpg"].size_kb == 1.0
    assert rows["b.jpg"].base64_data == base64.b64encode(bytes(range(256)) * 4).decode()
    assert rows["tiff2"].base64_data is None and rows["tiff2"].error.startswith("Unsupported image type: .tiff2")


def test_entries(spark):
    def at(h):
        return datetime.datetime(2024, 1, 1, h)

    old = spark.createDataFrame([("a", "text", "1", at(1), {}), ("b", "csv_table", None, at(1), {"path": "/p", "rows": "1234567", "column_names": "x, y"})], en.ENTRY_SCHEMA)
    new = spark.createDataFrame([("a", "markdown", "2", at(2), {}), ("c", "csv_query_result", "[]", at(1), {})], en.ENTRY_SCHEMA)
    stored = en.put_entries(old, new).cache()
    assert {r.data_id: r.content for r in stored.collect()} == {"a": "2", "b": None, "c": "[]"}
    payload = {r.data_id: r.p for r in stored.select("data_id", en.entry_payload().alias("p")).collect()}
    assert payload["a"] == "2" and payload["c"] == "(no rows)" and "Rows: 1,234,567\nColumns: x, y" in payload["b"]
    wanted = spark.createDataFrame([("a",), ("z",)], "data_id string")
    assert {r.data_id: r.found for r in en.entry_info(stored, wanted).collect()} == {"a": True, "z": False}
    assert [r.data_id for r in en.find_entries(stored, wanted).collect()] == ["a"]
    guard = en.row_guard(spark.createDataFrame([(200,), (201,)], "row_count int")).collect()
    assert guard[0].status == "ok" and "Too many rows (201)" in guard[1].status


def test_materialise_uses_the_session_folder(spark):
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert checkpoint_root(spark) == root
    df = materialise(spark.range(10).select((F.col("id") * 2).alias("x")), "t")
    assert df.count() == 10 and root in df.inputFiles()[0]


def _written(tmp_path, text):
    place = tmp_path / "own.csv"
    place.write_text(text)
    return str(place)


def test_single_quotes_and_quoted_line_breaks(spark, tmp_path):
    path = _written(tmp_path, "a;b\n'x;y';'z'\n'p;q';2\n")
    dialect = dl.csv_dialects(spark, [path]).first()
    assert (dialect["quote"], dialect["delimiter"]) == ("'", ";")
    table = dl.read_delimited(spark, path, ";", "'")
    assert table.columns == ["a", "b"] and [tuple(r) for r in table.collect()] == [("x;y", "z"), ("p;q", "2")]


def test_line_breaks_in_quotes_do_not_widen(spark, tmp_path):
    path = _written(tmp_path, 'a,b\n"x\n,1,2,3",y\n')
    table = dl.read_delimited(spark, path, multiline=True)
    assert table.columns == ["a", "b"] and table.first()["a"] == "x\n,1,2,3"


def test_ragged_rows_without_header(spark, tmp_path):
    path = _written(tmp_path, "1,2\n3\n4,5,6\n")
    table = dl.read_delimited(spark, path, header=False)
    assert [tuple(r) for r in table.collect()] == [("1", "2", None), ("3", None, None), ("4", "5", "6")]


def test_the_sample_is_not_gathered(spark, tmp_path):
    path = _written(tmp_path, "a,b\n1,2\n")
    assert "GlobalLimit" not in dl.csv_dialects(spark, [path])._jdf.queryExecution().toString()


def test_single_runs_are_kept_in_a_fixed_number_of_folders(spark, sf_dir, tmp_path):
    runs = scores._runs(spark, sf_dir)
    sinks.write_runs(runs, str(tmp_path / "runs"))
    folders = [p.relative_to(tmp_path / "runs").parts for p in (tmp_path / "runs").rglob("*.json")]
    assert len({f[2] for f in folders}) == 16 and all(len(f) == 4 and f[2].startswith("bucket=") for f in folders)
    back = spark.read.schema("run string, success boolean, duration_seconds double, error string, model string, benchmark string").json(str(tmp_path / "runs"))
    columns = ("model", "benchmark", "run", "success", "duration_seconds", "error")
    want = runs.withColumns({"model": F.replace("model", F.lit("/"), F.lit("_")), "run": F.concat(F.lit("run_"), "iteration")}).select(*columns)
    assert want.count() > 16 * 25 and back.select(*columns).exceptAll(want).isEmpty() and want.exceptAll(back.select(*columns)).isEmpty()


@pytest.mark.parametrize(
    "content, delimiter, quote, header",
    [
        ("a;b;c\n1;2\n3\n4;5;6\n", ";", '"', True), ("1;2\n3\n4;5;6\n7;8\n", ";", '"', False), ("x y\nz, w\nv\nu\n", ",", '"', True),
        ("'no. 0; A'\n'no. 1; B';7\n'no. 2; C';8;more\n", ";", "'", False), ("2024-01-01|x1\n2024-01-02|y2\n", "|", '"', False),
        ("day|id\n2024-01-01|x1\n2024-01-02|y2\n", "|", '"', True), ("1:30,5\n2:45,6\n", ",", '"', False),
        ('"a ""q"", b","c"\n"1","2"\n"3","4"\n', ",", '"', True), ('"1","2"\n"3","4"\n', ",", '"', False), ("\n\n", ",", '"', True),
    ],
)
def test_ragged_and_headerless_dialects(spark, put, content, delimiter, quote, header):
    row = dl.csv_dialects(spark, [put("d.csv", content)]).first()
    assert (row.delimiter, row.quote, row.has_header) == (delimiter, quote, header)


def test_dialects_of_many_paths_are_one_plan(spark, put, tmp_path):
    (tmp_path / "dir ä+").mkdir()
    paths = {put("a.csv", "k;v\n1;2\n"): ";", put("b 1.csv", "k|v\n1|2\n3|4\n"): "|", put("dir ä+/b.csv", "k\tv\n1\t2\n"): None, put("dir ä+/a.csv", ""): None}
    asked = [p for p, d in paths.items() if d] + [str(tmp_path / "dir ä+"), f"file:{tmp_path}/b*.csv"]
    found = dl.csv_dialects(spark, asked[:3])
    assert {r.path: r.delimiter for r in found.collect()} == {asked[0]: ";", asked[1]: "|", asked[2]: "\t"}
    assert [r.delimiter for r in dl.csv_dialects(spark, asked[3:]).collect()] == ["|"]
    plan = dl._heads(spark, asked[:3], 1000, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and plan.count("Union") == 0
    rows = {(r.path, tuple(r.cells)) for r in dl.split_lines(spark, found).collect()}
    assert rows == {(asked[0], ("1", "2")), (asked[1], ("1", "2")), (asked[1], ("3", "4")), (asked[2], ("1", "2"))}


def test_cells_of_lines(spark):
    rows = [('a,"b, ""c""",d', ",", '"'), ("'x;y';;z", ";", "'"), ("", ",", '"'), (",", ",", '"'), ('"",x', ",", '"'), ("a|b]|c", "|", '"'), ('in"side,"x', ",", '"')]
    data = spark.createDataFrame(rows, "line string, d string, q string")
    got = [r[0] for r in data.select(dl._cells(F.col("line"), F.col("d"), F.col("q"))).collect()]
    assert got == [["a", 'b, "c"', "d"], ["x;y", "", "z"], [""], ["", ""], ["", "x"], ["a", "b]", "c"], ['in"side', '"x']]


def test_rows_and_width_by_one_scan(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "1.csv").write_text("a,b\n1,2\n\n3,4,5\n")
    (tmp_path / "t" / "2.csv").write_text("a,b\n  \n6\n")
    (tmp_path / "t" / "3.csv").write_text("")
    assert dl.measure(spark, str(tmp_path / "t"), ",") == (3, 5, 2)
    table, entry = dl.load_delimited(spark, str(tmp_path / "t"))
    assert entry.first().rows == table.count() == 3 and entry.first().columns == 3


def test_lines_of_an_export_in_order(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(5000).selectExpr("id", "CASE WHEN id % 9 = 0 THEN '' ELSE concat('line ', id, repeat('x', CAST(id % 40 AS int))) END AS line")
    want = [(r.id + 1, r.line) for r in rows.orderBy("id").collect()]
    rows.repartition(7).orderBy("id").select("line").write.text(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9k")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        back = fl.read_ordered_lines(spark, path)
        assert back.rdd.getNumPartitions() > 1 and sorted(map(tuple, back.collect())) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
