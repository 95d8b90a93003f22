"""Queries of scoring and of benchmark runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabledoc.functions.expressions import norm_string
from tabledoc.functions.similarity import add_similarity, add_url_similarity
from tabledoc.operators import runs as rn
from tabledoc.operators import scoring as sc
from tabledoc.plans.registry import query
from tabledoc.session import load_table, scratch_dir
from tabledoc.sources import delimited
from tabledoc.sources.sinks import write_records, write_runs

# --------------------------------------------------------------- two tables made of part
# the actual table lacks every tenth part, repeats another tenth with wrong values first,
# and differs in links, names and counts in ways whose ratio is known exactly

_EXPECTED = """SELECT p_brand AS `Set`, concat(p_type, ' Era') AS `Era`, CAST(p_partkey AS {s}) AS `Set No.`,
    concat('http://a.example/img/', replace(p_name, ' ', '%20'), '.png') AS `Symbol`, p_name AS `Japanese Name`, p_type AS `English Equivalent`,
    CAST(p_size AS {s}) AS `No. of Cards`, concat('Jan ', p_size % 28 + 1) AS `Release Date` FROM part"""
_ACTUAL = """SELECT concat('  ', lower(p_brand), ' ') AS `Set`, upper(p_type) AS `Era`, CAST(p_partkey AS {s}) AS `Set No.`,
    CASE WHEN p_partkey % 10 = 4 THEN '' ELSE concat('https://b.example:80/', p_size, '/', replace(p_name, ' ', '%20'), '.png?x=1#f') END AS `Symbol`,
    CASE WHEN wrong = 1 THEN 'zzz' WHEN p_partkey % 10 = 3 THEN concat(p_name, ' ~~') WHEN p_partkey % 10 = 6 THEN '' ELSE upper(p_name) END AS `Japanese Name`,
    CASE WHEN p_partkey % 10 = 2 THEN concat(p_type, '!') ELSE p_type END AS `English Equivalent`,
    CAST(p_size AS {s}) AS `No. of Cards`, concat('Jan  ', p_size % 28 + 1) AS `Release Date`, p_partkey * 2 + 1 - wrong AS row_no
    FROM (SELECT *, 0 AS wrong FROM part WHERE p_partkey % 10 <> 9 UNION ALL SELECT *, 1 AS wrong FROM part WHERE p_partkey % 10 = 5)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    load_table(spark, sf_dir, "part").createOrReplaceTempView("part")
    return spark.sql(_EXPECTED.format(s="STRING")), spark.sql(_ACTUAL.format(s="STRING"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.score_rows(*_sides(spark, sf_dir))


def _duck_norm(col: str) -> str:
    return rf"lower(trim(regexp_replace(regexp_replace(coalesce({col}, ''), '(?i)\s*era\s*$', ''), '\s+', ' ', 'g')))"


def _duck_ratio(a: str, b: str) -> str:
    a, b = _duck_norm(a), _duck_norm(b)
    return (
        f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE "
        f"WHEN starts_with({b}, {a}) THEN 2.0::DOUBLE * length({a}) / (length({a}) + length({b})) END"
    )


def _quote(sql: str) -> str:
    return sql.replace("`", '"').format(s="VARCHAR")


_KEY = " || '/' || ".join(_duck_norm(f'"{c}"') for c in sc.KEY_COLUMNS)
_FILE = r"regexp_extract(regexp_replace({}, '[?#].*$', ''), '([^/]*)$', 1)"
_TEXT = ", ".join(
    "CASE WHEN a.k IS NOT NULL THEN " + _duck_ratio(f'e."{c}"', f'a."{c}"') + f" END AS s{i}"
    for i, c in enumerate(sc.TEXT_COLUMNS, 1)
)
_DUCK_SCORES = f"""WITH e AS (SELECT *, {_KEY} AS k FROM ({_quote(_EXPECTED)})),
    a AS (SELECT *, {_KEY} AS k FROM ({_quote(_ACTUAL)}) QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY row_no DESC) = 1),
    s AS (SELECT e.k AS row_key, a.k IS NOT NULL AS matched,
        CASE WHEN a.k IS NULL THEN NULL WHEN a."Symbol" = '' THEN 0.0::DOUBLE WHEN {_FILE.format('e."Symbol"')} = {_FILE.format('a."Symbol"')} THEN 1.0::DOUBLE END AS s0,
        {_TEXT} FROM e LEFT JOIN a ON e.k = a.k),
    r AS (SELECT *, CASE WHEN matched THEN (s0 + s1 + s2 + s3 + s4) / 5 ELSE 0.0::DOUBLE END AS row_score FROM s)"""


@query(
    "norm_string",
    f"""SELECT p_partkey, {_duck_norm("p_name || '  of the  ' || p_type || ' Era '")} AS norm FROM part""",
)
def norm_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("p_name", F.lit("  of the  "), "p_type", F.lit(" Era "))
    return load_table(spark, sf_dir, "part").select("p_partkey", norm_string(text).alias("norm"))


@query("row_key", f"SELECT {_KEY} AS row_key FROM ({_quote(_ACTUAL)})")
def row_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    actual = _sides(spark, sf_dir)[1]
    return actual.select(F.concat_ws("/", sc.row_key(actual)["k0"], sc.row_key(actual)["k1"], sc.row_key(actual)["k2"]).alias("row_key"))


@query(
    "similarity",
    f"""SELECT p_partkey, round({_duck_ratio("p_name", "p_name || ' ' || p_type")}, 6) AS extended, round({_duck_ratio("p_name", "upper(p_name)")}, 6) AS same,
               0.0::DOUBLE AS nothing FROM part""",
)
def similarity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = load_table(spark, sf_dir, "part")
    pairs = {
        "extended": ("p_name", F.concat("p_name", F.lit(" "), "p_type")),
        "same": ("p_name", F.upper("p_name")),
        "nothing": ("p_name", F.lit("")),
    }
    return add_similarity(parts, pairs).select(
        "p_partkey", F.round("extended", 6).alias("extended"), "same", "nothing"
    )


@query(
    "url_similarity",
    """SELECT page_id, 1.0::DOUBLE AS same_file, CASE WHEN coalesce(url, '') = '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS one_empty, 1.0::DOUBLE AS encoded,
              round(2.0::DOUBLE * length(host) / (2 * length(host) + 2), 6) AS other
       FROM (SELECT page_id, url, '/d/' || regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages)""",
)
def url_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    elsewhere = F.regexp_replace("url", "^[a-z]+://[^/?#]*", "ftp://mirror.example/copies")
    path = F.concat(F.lit("http://h.example/d/"), F.regexp_extract("url", "://([^/?#]*)", 1))
    pairs = {
        "same_file": ("url", elsewhere),
        "one_empty": ("url", F.lit("")),
        "encoded": (F.concat(path, F.lit("/a b")), F.concat(path, F.lit("/c/a%20b"))),
        "other": (path, F.concat(path, F.lit("~~"))),
    }
    return add_url_similarity(load_table(spark, sf_dir, "pages").select("page_id", "url"), pairs).drop("url").withColumn(
        "other", F.round("other", 6)
    )


@query(
    "last_wins",
    "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1",
)
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load_table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return sc.last_wins(events, "event_id", "user_id", "event_type")


def _written(spark: SparkSession, actual: DataFrame) -> str:
    """The actual table as a delimited file in the shared folder, in the order of its rows."""
    path = scratch_dir(spark, "output-csv")
    ordered = actual.repartitionByRange("row_no").sortWithinPartitions("row_no")
    ordered.drop("row_no").write.csv(path, header=True, sep=";", escape='"')
    return path


@query(
    "missing_headers",
    f"""SELECT name AS missing, (SELECT CAST(count(*) AS BIGINT) FROM ({_quote(_ACTUAL)})) AS n_rows FROM
        (SELECT unnest(['Set', 'Era', 'Set No.', 'Symbol', 'Japanese Name', 'English Equivalent', 'No. of Cards', 'Release Date']) AS name)
        WHERE name NOT IN (SELECT unnest(['Set', 'Era', 'Set No.', 'Japanese Name', 'English Equivalent', 'No. of Cards']))""",
)
def missing_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the header line of a written table lacks, by an anti-join of names, with the rows of the file."""
    path = _written(spark, _sides(spark, sf_dir)[1].drop("Symbol", "Release Date"))
    dialect = delimited.csv_dialects(spark, [path]).first()
    rows = delimited.read_delimited(spark, path, dialect["delimiter"], dialect["quote"], dialect["has_header"]).count()
    gone = sc.missing_names(delimited.header_cells(spark, path))
    return gone.select(F.col("name").alias("missing"), F.lit(rows).cast("bigint").alias("n_rows"))


def _row_key():
    return F.concat_ws("/", "key.k0", "key.k1", "key.k2").alias("row_key")


@query("score_match", _DUCK_SCORES + "SELECT row_key, matched FROM r")
def score_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.match_rows(*_sides(spark, sf_dir)).select(_row_key(), "matched")


@query(
    "score_rows",
    _DUCK_SCORES + "SELECT row_key, matched, s0, round(s1, 6) AS s1, round(s2, 6) AS s2, s3, s4, round(row_score, 6) AS row_score FROM r",
)
def score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select(
        _row_key(), "matched", "s0", F.round("s1", 6).alias("s1"), F.round("s2", 6).alias("s2"), "s3", "s4",
        F.round("row_score", 6).alias("row_score"),
    )


@query(
    "score_columns",
    _DUCK_SCORES
    + """SELECT * FROM (SELECT unnest(['Symbol', 'Japanese Name', 'English Equivalent', 'Release Date', 'No. of Cards']) AS "column",
              CAST(count(*) AS BIGINT) AS n, unnest([round(avg(s0), 6), round(avg(s1), 6), round(avg(s2), 6), round(avg(s3), 6), round(avg(s4), 6)]) AS mean_score
         FROM r WHERE matched)""",
)
def score_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.score_columns(_scores(spark, sf_dir)).withColumn("mean_score", F.round("mean_score", 6))


@query(
    "score_final",
    _DUCK_SCORES
    + """SELECT CAST(count(*) AS BIGINT) AS total_rows, CAST(count(*) FILTER (WHERE row_score > 0) AS BIGINT) AS matched_rows, 1.0::DOUBLE AS header_score,
              round(avg(row_score), 6) AS avg_row_score, round(0.2 + 0.8 * avg(row_score), 6) AS final_score, 0.2 + 0.8 * avg(row_score) >= 0.9 AS success FROM r""",
)
def score_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected, actual = _sides(spark, sf_dir)
    return sc.score_final(sc.score_rows(expected, actual), sc.header_score(actual.columns)).withColumns(
        {c: F.round(c, 6) for c in ("avg_row_score", "final_score")}
    )


@query(
    "score_missing_column",
    _DUCK_SCORES
    + """, x AS (SELECT CASE WHEN matched THEN (s0 + s1 + s2 + s3) / 5 ELSE 0.0::DOUBLE END AS row_score FROM s)
         SELECT CAST(count(*) AS BIGINT) AS total_rows, CAST(count(*) FILTER (WHERE row_score > 0) AS BIGINT) AS matched_rows, 0.0::DOUBLE AS header_score,
              round(avg(row_score), 6) AS avg_row_score, round(0.8 * avg(row_score), 6) AS final_score, 0.8 * avg(row_score) >= 0.9 AS success FROM x""",
)
def score_missing_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table without one of the expected columns: no header score, and nothing for that column."""
    expected, actual = _sides(spark, sf_dir)
    actual = actual.drop("No. of Cards")
    return sc.score_final(sc.score_rows(expected, actual), sc.header_score(actual.columns)).withColumns(
        {c: F.round(c, 6) for c in ("avg_row_score", "final_score")}
    )


_VERDICT = """success, CAST(NULL AS VARCHAR) AS error, CAST(total_rows AS BIGINT) AS total_rows, CAST(matched_rows AS BIGINT) AS matched_rows,
    header_score, round(avg_row_score, 6) AS avg_row_score, round(final_score, 6) AS final_score"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("avg_row_score", "final_score")})


@query(
    "score_output",
    _DUCK_SCORES
    + f""", v AS (SELECT count(*) AS total_rows, count(*) FILTER (WHERE row_score > 0) AS matched_rows, 1.0::DOUBLE AS header_score, avg(row_score) AS avg_row_score,
            0.2 + 0.8 * avg(row_score) AS final_score, 0.2 + 0.8 * avg(row_score) >= 0.9 AS success FROM r) SELECT {_VERDICT} FROM v""",
)
def score_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on a written file: dialect, header and last rows are those of the file."""
    expected, actual = _sides(spark, sf_dir)
    return _rounded(sc.score_output(expected, _written(spark, actual)))


@query(
    "score_output_empty",
    f"""WITH v AS (SELECT count(*) FILTER (WHERE p_partkey IS NULL) AS total_rows, 0 AS matched_rows, 1.0::DOUBLE AS header_score, 1.0::DOUBLE AS avg_row_score,
            1.0::DOUBLE AS final_score, true AS success FROM part) SELECT {_VERDICT} FROM v""",
)
def score_output_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No expected row: a success, whatever the output has."""
    expected, actual = _sides(spark, sf_dir)
    return _rounded(sc.score_output(expected.where("`Set No.` IS NULL"), _written(spark, actual)))


@query(
    "score_output_missing",
    """SELECT false AS success, 'output_csv_missing' AS error, CAST(NULL AS BIGINT) AS total_rows, CAST(NULL AS BIGINT) AS matched_rows, CAST(NULL AS DOUBLE) AS header_score,
              CAST(NULL AS DOUBLE) AS avg_row_score, CAST(NULL AS DOUBLE) AS final_score FROM (SELECT count(*) FROM part)""",
)
def score_output_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected rows, but no file was written."""
    return sc.score_output(_sides(spark, sf_dir)[0], scratch_dir(spark, "never-written"))


@query(
    "score_report",
    _DUCK_SCORES
    + """SELECT unnest(['header_score', 'total_rows', 'matched_rows', 'avg_row_score', 'final_score', 'column Symbol', 'column Japanese Name',
                'column English Equivalent', 'column Release Date', 'column No. of Cards']) AS item,
              unnest([1.0, count(*), count(*) FILTER (WHERE row_score > 0), round(avg(row_score), 6), round(0.2 + 0.8 * avg(row_score), 6), round(avg(s0), 6),
                round(avg(s1), 6), round(avg(s2), 6), round(avg(s3), 6), round(avg(s4), 6)]::DOUBLE[]) AS value FROM r""",
)
def score_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.score_report(_scores(spark, sf_dir), 1.0).withColumn("value", F.round("value", 6))


# --------------------------------------------------------------- runs made of events
def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_table(spark, sf_dir, "events").select(
        F.expr("concat('org/m', user_id % 5)").alias("model"),
        F.col("event_type").alias("benchmark"),
        F.col("event_id").alias("iteration"),
        (F.col("value") > 50).alias("success"),
        F.col("value").alias("duration_seconds"),
        F.expr("CASE WHEN value > 95 THEN 'timeout' END").alias("error"),
        F.expr("CASE WHEN event_type <> 'error' AND event_id % 3 = 0 THEN map('final_score', value / 100) END").alias("metrics"),
    )


_DUCK_RUNS = """r AS (SELECT 'org/m' || (user_id % 5) AS model, event_type AS benchmark, event_id AS iteration, value > 50 AS success,
    value AS duration, CASE WHEN value > 95 THEN 'timeout' END AS error, CASE WHEN event_type <> 'error' AND event_id % 3 = 0 THEN value / 100 END AS score FROM events)"""


@query(
    "run_summary",
    f"""WITH {_DUCK_RUNS} SELECT model, benchmark, CAST(grouping_id(model, benchmark) AS BIGINT) AS level, CAST(count(*) AS BIGINT) AS runs,
              CAST(count(*) FILTER (WHERE success) AS BIGINT) AS successes, round(count(*) FILTER (WHERE success) * 100.0 / count(*), 4) AS success_rate,
              round(avg(duration), 4) AS avg_duration, round(coalesce(stddev_samp(duration), 0), 4) AS std_duration, round(sum(duration), 2) AS total_duration,
              bool_and(success) AS all_passed FROM r GROUP BY ROLLUP (model, benchmark)""",
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rn.run_summary(_runs(spark, sf_dir)).withColumns(
        {c: F.round(c, 4) for c in ("success_rate", "avg_duration", "std_duration")}
        | {"total_duration": F.round("total_duration", 2), "level": F.col("level").cast("bigint")}
    )


@query(
    "run_scores",
    f"WITH {_DUCK_RUNS} SELECT model, benchmark, CAST(count(score) AS BIGINT) AS scored_runs, round(avg(score), 6) AS avg_score FROM r GROUP BY model, benchmark",
)
def run_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rn.run_scores(_runs(spark, sf_dir)).withColumn("avg_score", F.round("avg_score", 6))


@query(
    "run_score_list",
    f"""WITH {_DUCK_RUNS}, i AS (SELECT *, row_number() OVER (PARTITION BY model, benchmark ORDER BY iteration) AS idx FROM r)
        SELECT model, benchmark, CAST((idx - 1) // 100 AS BIGINT) AS page_no,
               string_agg(idx || '=' || printf('%.2f', round(score * 100) / 100), ', ' ORDER BY idx) AS scores FROM i WHERE score IS NOT NULL GROUP BY model, benchmark, page_no""",
)
def run_score_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = _runs(spark, sf_dir).withColumn(
        "metrics", F.transform_values("metrics", lambda _, v: F.round(v * 100) / 100)
    )
    return rn.run_score_list(rounded)


_RECORD = """'{"benchmark":"' || benchmark || '","model":"' || model || '","success":' || CAST(success AS VARCHAR) || ',"duration":' || CAST(duration AS VARCHAR)
    || CASE WHEN error IS NULL THEN '' ELSE ',"error":"' || error || '"' END || '}'"""


@query("runs_json", f"WITH {_DUCK_RUNS} SELECT {_RECORD} AS record FROM r")
def runs_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run as a JSON record, written and read back."""
    path = scratch_dir(spark, "runs-json")
    write_records(rn.run_records(_runs(spark, sf_dir)), path)
    return spark.read.text(path).select(F.col("value").alias("record"))


@query(
    "sink_runs",
    f"""WITH {_DUCK_RUNS} SELECT replace(model, '/', '_') AS model, benchmark, 'run_' || iteration % 7 AS run, CAST(count(*) AS BIGINT) AS n, round(sum(duration), 2) AS total
        FROM r GROUP BY ALL""",
)
def sink_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run written under its own name and read back; only the summary joins runs, by number modulo 7."""
    path = scratch_dir(spark, "runs")
    write_runs(_runs(spark, sf_dir), path)
    schema = "run string, success boolean, duration_seconds double, error string, model string, benchmark string, bucket string"
    back = spark.read.schema(schema).json(path)
    number = F.substring("run", len("run_") + 1, 20).cast("bigint")
    return back.groupBy("model", "benchmark", F.concat(F.lit("run_"), number % 7).alias("run")).agg(
        F.count("*").alias("n"), F.round(F.sum("duration_seconds"), 2).alias("total")
    )
