"""Queries over ``documents``."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabledoc.functions.expressions import slug, verify_contains
from tabledoc.operators import text_ops as tx
from tabledoc.operators.tabular import map_rows
from tabledoc.plans.registry import query
from tabledoc.session import load_spread, scratch_dir
from tabledoc.sources.files import read_ordered_lines
from tabledoc.sources.sinks import write_combined, write_sections, write_text


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_spread(spark, sf_dir, "documents", "doc_id")


# --------------------------------------------------------------- Markdown made of the documents
# every line becomes a heading, its level by its length, under one title; inside a document
# the lines also become the rows of two pipe tables

_MD_LINE = "concat(repeat('#', CAST(2 + length(l) % 3 AS INT)), ' ', l)"


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = f"array_join(transform(split(text, '\\n'), l -> {_MD_LINE}), '\\nplain text\\n')"
    return _docs(spark, sf_dir).select(
        "doc_id", F.expr(f"concat('# Title ', source, '\\n', {body}, '\\n```\\n# code\\n```')").alias("text")
    )


_DUCK_LINES = """SELECT doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) AS i,
    unnest(string_split(text, chr(10))) AS l FROM documents"""
# heading i of a document is on line 2i; white space around its text is dropped
_DUCK_HEADINGS = f"""SELECT doc_id, 1 AS line, 1 AS level, 'Title ' || source AS text FROM documents
    UNION ALL SELECT doc_id, CAST(2 * i AS INT), CAST(2 + length(l) % 3 AS INT), trim(l) FROM ({_DUCK_LINES}) WHERE trim(l) <> ''"""


@query("md_headings", _DUCK_HEADINGS)
def md_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.md_headings(_markdown(spark, sf_dir))


_SECTION = f"""WITH h AS ({_DUCK_HEADINGS}),
         hit AS (SELECT doc_id, min(line) AS line FROM h WHERE contains(lower(text), 'the') GROUP BY doc_id),
         sel AS (SELECT h.* FROM h JOIN hit USING (doc_id, line)),
         stop AS (SELECT s.doc_id, min(h.line) AS line FROM sel s JOIN h ON h.doc_id = s.doc_id AND h.line > s.line AND h.level <= s.level GROUP BY s.doc_id)
       """


@query(
    "md_section",
    _SECTION
    + """SELECT d.doc_id, sel.line IS NOT NULL AS found, sel.text AS heading, sel.level, sel.line AS start_line, stop.line AS end_line
       FROM documents d LEFT JOIN sel USING (doc_id) LEFT JOIN stop ON stop.doc_id = d.doc_id""",
)
def md_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.md_section(_markdown(spark, sf_dir), "the").drop("section")


@query(
    "md_section_text",
    _SECTION
    + """, md AS (SELECT doc_id, string_split('# Title ' || source || chr(10) || array_to_string(list_transform(string_split(text, chr(10)),
             lambda l: repeat('#', CAST(2 + length(l) % 3 AS INT)) || ' ' || l), chr(10) || 'plain text' || chr(10)) || chr(10) || '```' || chr(10) || '# code' || chr(10) || '```', chr(10)) AS lines FROM documents)
       SELECT doc_id, CASE WHEN sel.line IS NOT NULL THEN array_to_string(lines[sel.line:coalesce(stop.line - 1, len(lines))], chr(10)) ELSE
           'Error: No heading found matching ''the''.' || chr(10) || chr(10) || 'Available headings:' || chr(10) || first.listed END AS section
       FROM md LEFT JOIN sel USING (doc_id) LEFT JOIN stop USING (doc_id)
       JOIN (SELECT doc_id, string_agg('  - ' || text, chr(10) ORDER BY line) FILTER (WHERE i <= 10) || CASE WHEN count(*) > 10 THEN chr(10) || '  ... and ' || (count(*) - 10) || ' more' ELSE '' END AS listed
             FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS i FROM h) GROUP BY doc_id) first USING (doc_id)""",
)
def md_section_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.md_section(_markdown(spark, sf_dir), "the", max_listed=tx.SECTION_HEADINGS_LISTED).select("doc_id", "section")


def _tabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = "array_join(transform(split(replace(text, '|', '/'), '\\n'), (l, i) -> concat('| ', i, ' | ', l, ' |')), '\\n')"
    head = "'\\n| no | line |\\n|----|:----|\\n'"
    return _docs(spark, sf_dir).select(
        "doc_id",
        F.expr(
            f"concat('## Part ', lang, {head}, {rows}, '\\n\\n### not a section\\n| no | alone |\\n|--|--|\\n\\n## ', source, {head}, {rows})"
        ).alias("text"),
    )


_DUCK_TABLES = r"""WITH l AS (SELECT doc_id, lang, source, generate_subscripts(string_split(replace(text, '|', '/'), chr(10)), 1) AS i,
         regexp_replace(unnest(string_split(replace(text, '|', '/'), chr(10))), '^\s+|\s+$', '', 'g') AS l FROM documents),
       r AS (SELECT doc_id, lang, source, 1 AS row_no, 'no' AS a, 'line' AS b FROM documents
             UNION ALL SELECT doc_id, lang, source, CAST(i + 1 AS INT), CAST(i - 1 AS VARCHAR), l FROM l),
       t AS (SELECT doc_id, 'Part ' || lang AS section, 1 AS table_no, row_no, a, b FROM r
             UNION ALL SELECT doc_id, source, 2, row_no, a, b FROM r)"""


@query("md_tables", _DUCK_TABLES + "SELECT doc_id, section, table_no, row_no, a || '~' || b AS cells FROM t")
def md_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tx.md_table_rows(_tabled(spark, sf_dir))
    return rows.withColumn("cells", F.array_join("cells", "~"))


@query(
    "md_tables_combined",
    _DUCK_TABLES
    + """SELECT row_number() OVER (ORDER BY doc_id, table_no, part, row_no) AS line_no, line FROM
         (SELECT doc_id, table_no, 2 AS part, row_no, a || ',' || CASE WHEN regexp_matches(b, '[",\\r]') THEN '"' || replace(b, '"', '""') || '"' ELSE b END AS line FROM t
          UNION ALL SELECT doc_id, table_no, 0, 0, '=== ' || section || ' ===' FROM t WHERE row_no = 1
          UNION ALL SELECT doc_id, table_no, 1, 0, '' FROM t WHERE row_no = 1 UNION ALL SELECT doc_id, table_no, 3, 0, '' FROM t WHERE row_no = 1)""",
)
def md_tables_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the combined file of all documents and reads it back line by line, in the order of its files."""
    path = scratch_dir(spark, "combined")
    write_combined(tx.md_tables_combined(tx.md_table_rows(_tabled(spark, sf_dir))), path)
    return read_ordered_lines(spark, path)


@query(
    "sink_sections",
    _DUCK_TABLES
    + r"""SELECT lower(regexp_replace(regexp_replace(section, '[^\w\s-]', '', 'g'), '[-\s]+', '_', 'g')) AS section_slug,
                 doc_id, table_no, row_no, a || '~' || b AS cells FROM t""",
)
def sink_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the table rows by section and reads every cell back."""
    path = scratch_dir(spark, "sections")
    write_sections(tx.md_table_rows(_tabled(spark, sf_dir)), path)
    back = spark.read.csv(path, header=True, escape='"', schema="doc_id bigint, table_no int, row_no int, cells string, section_slug string")
    return back.withColumn("cells", F.array_join(F.from_json("cells", "array<string>"), "~"))


# --------------------------------------------------------------- search
_DUCK_GREP = """SELECT doc_id, generate_subscripts(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10)), 1) AS line_no,
    unnest(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10))) AS line FROM documents"""


@query(
    "grep_context",
    f"""SELECT doc_id, CAST(line_no AS INT) AS line_no, hit, line FROM
       (SELECT *, max(hit) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM
        (SELECT *, regexp_matches(line, '(?i)licen[sc]e|https?://') AS hit FROM ({_DUCK_GREP})))
       WHERE near""",
)
def grep_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.grep_context(_docs(spark, sf_dir), "licen[sc]e|https?://")


@query(
    "grep_report",
    f"""WITH hits AS (SELECT * FROM ({_DUCK_GREP}) WHERE regexp_matches(line, '(?i)released|copyright'))
        SELECT doc_id, CASE WHEN length(r) > 15000 THEN left(r, 15000) || chr(10) ||
          '...(truncated due to max length. Try narrowing your query or reducing context lines)...' ELSE r END AS report
        FROM (SELECT doc_id, string_agg(line_no || ':' || line, chr(10) ORDER BY line_no) AS r FROM hits GROUP BY doc_id)""",
)
def grep_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.grep_report(_docs(spark, sf_dir), "released|copyright", context_lines=0, max_chars=tx.GREP_OUTPUT_CHARS)


@query(
    "grep_report_context",
    f"""WITH l AS (SELECT *, regexp_matches(line, '(?i)licen[sc]e|https?://') AS hit FROM ({_DUCK_GREP})),
        near AS (SELECT *, max(hit) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS shown FROM l),
        kept AS (SELECT *, lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS prev FROM near WHERE shown)
        SELECT doc_id, string_agg(CASE WHEN prev < line_no - 1 THEN '--' || chr(10) ELSE '' END || line_no || CASE WHEN hit THEN ':' ELSE '-' END || line, chr(10) ORDER BY line_no) AS report
        FROM kept GROUP BY doc_id""",
)
def grep_report_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing with two lines of context and marks between separate stretches, uncut."""
    return tx.grep_report(_docs(spark, sf_dir), "licen[sc]e|https?://", context_lines=2)


@query(
    "grep_literal",
    f"""SELECT doc_id, CAST(line_no AS INT) AS line_no, line FROM
        (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS rn FROM ({_DUCK_GREP}) WHERE contains(lower(line), 'the '))
        WHERE rn <= 10""",
)
def grep_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.grep_literal(_docs(spark, sf_dir), "The ", max_lines=tx.GREP_MAX_LINES)


@query(
    "byte_slice",
    """SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes,
              list_aggregate(list_transform(list_filter(list_transform(range(1, least(length(text), 80) + 1),
                  lambda i: {'c': text[i], 'a': octet_length(encode(left(text, i - 1))), 'b': octet_length(encode(left(text, i)))}),
                  lambda s: s.a >= 11 AND s.b <= 51), lambda s: s.c), 'string_agg', '') AS slice
       FROM documents""",
)
def byte_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes 11 to 51: edges fall into two-byte letters of the accented languages."""
    rows = tx.byte_slice(_docs(spark, sf_dir), offset=11, limit=40)
    return rows.withColumn("slice", F.nullif("slice", F.lit("")))


# --------------------------------------------------------------- chunks
_DUCK_CHUNKS = """WITH RECURSIVE c(doc_id, chunk_no, s, e, n, text) AS (
    SELECT doc_id, 0, 0, 0, length(text), text FROM documents
    UNION ALL
    SELECT doc_id, chunk_no + 1, e, CASE WHEN e + {size} >= n THEN n WHEN pos = 0 THEN e + {size} ELSE e + {size} + 1 - pos END, n, text
    FROM (SELECT *, instr(reverse(substring(text, e + {size} - 199, 200)), chr(10)) AS pos FROM c WHERE e < n))"""


@query(
    "text_chunks",
    _DUCK_CHUNKS.format(size=15000)
    + """SELECT doc_id, chunk_no, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", CAST(e - s AS INT) AS size,
                substring(text, s + 1, e - s) AS chunk FROM c WHERE chunk_no > 0""",
)
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.text_chunks(_docs(spark, sf_dir))


@query(
    "chunk_map_merge",
    _DUCK_CHUNKS.format(size=1000)
    + """, f AS (SELECT doc_id, chunk_no, s, e, array_to_string(list_sort(list_distinct(
                   regexp_extract_all(substring(text, s + 1, e - s), '(?i)\\b[a-z0-9.]+@[a-z0-9.]+|mit license'))), ', ') AS result FROM c WHERE chunk_no > 0)
       SELECT doc_id, CAST(count(*) AS BIGINT) AS n_results, string_agg('=== Chunk ' || chunk_no || ' (chars ' || s || '-' || e || ') ===' || chr(10)
              || result || chr(10), '' ORDER BY chunk_no) AS merged FROM f WHERE result <> '' GROUP BY doc_id""",
)
def chunk_map_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = tx.text_chunks(_docs(spark, sf_dir), size=1000)
    return tx.merge_chunks(tx.find_in_chunks(chunks, r"\b[a-z0-9.]+@[a-z0-9.]+|mit license"))


@query(
    "row_map_task",
    """SELECT doc_id, chunk_no, 'words: ' || len(list_filter(regexp_split_to_array(chunk, '\\s+'), lambda w: w <> '')) AS result FROM ("""
    + _DUCK_CHUNKS.format(size=5000)
    + "SELECT doc_id, chunk_no, substring(text, s + 1, e - s) AS chunk FROM c WHERE chunk_no > 0)",
)
def row_map_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user function over rows, here a word count."""
    chunks = tx.text_chunks(_docs(spark, sf_dir), size=5000)
    counted = map_rows(chunks, lambda row: f"words: {len(json.loads(row)['chunk'].split())}")
    return counted.select("doc_id", "chunk_no", "result")


# --------------------------------------------------------------- expressions and sinks
@query(
    "slug",
    r"""SELECT doc_id, lower(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}_\s-]', '', 'g'), '[-\s]+', '_', 'g')) AS slug FROM documents""",
)
def slug_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", slug("text").alias("slug"))


@query("verify_contains", "SELECT doc_id, contains(text, '151') AS success FROM documents")
def verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", verify_contains("text", "151").alias("success"))


@query(
    "sink_text",
    f"""SELECT line, CAST(2 * count(*) AS BIGINT) AS n FROM
        (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY line""",
)
def sink_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines written, then appended once more, then read back."""
    path = scratch_dir(spark, "text")
    lines = _docs(spark, sf_dir).select(F.explode(F.split("text", "\n")).alias("line"))
    write_text(lines, path, "line")
    write_text(lines, path, "line", append=True)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))
