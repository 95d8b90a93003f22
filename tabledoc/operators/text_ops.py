"""Markdown and plain-text operators.

A document is one row and its key names it alone, so line work is done inside the row with
array functions and needs no exchange; only table discovery, which numbers islands of lines,
exchanges the (few) lines that belong to tables or section headings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# ---- fixed values of the text operators ----
CHUNK_CHARS = 15_000
CHUNK_BACKOFF = 200
GREP_OUTPUT_CHARS = 15_000
GREP_CONTEXT = 3
GREP_MAX_LINES = 10
SECTION_HEADINGS_LISTED = 10
READ_LIMIT = 1_024
MAX_TEXT_BYTES = 256 * 1_024
NOTHING_FOUND = "no relevant information found"
NO_RESULT = "No relevant information found in this chunk"
CHUNK_ERROR = "Error processing chunk: "
NO_HEADINGS_ERROR = "Error: No headings found in markdown content"
NO_MATCH_ERROR = "Error: No heading found matching "
HEADINGS_LISTED = "Available headings:"
CHUNK_TITLE = "=== Chunk "
CHUNK_CHARACTERS = " (chars "
CHUNK_TITLE_END = ") ==="
GREP_CUT = "...(truncated due to max length. Try narrowing your query or reducing context lines)..."

_TRIM = r"r'(?U)^\s+|\s+$'"


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


# --------------------------------------------------------------- headings and sections

# a fenced block, or an unclosed one up to the end
_FENCE = r"r'(?ms)^ {0,3}(```|~~~)[^\n]*$(?:.*?^ {0,3}\1[`~]*[ \t]*$|.*\z)'"


def _without_code(text: str) -> str:
    """SQL: ``text`` with fenced blocks blanked out but their line breaks kept."""
    return rf"""CASE WHEN instr({text}, '```') = 0 AND instr({text}, '~~~') = 0 THEN {text} ELSE
        array_join(zip_with(split({text}, {_FENCE}), regexp_extract_all({text}, {_FENCE}, 0),
            (a, b) -> concat(coalesce(a, ''), regexp_replace(coalesce(b, ''), r'[^\n]', ''))), '') END"""


def headings_of(text: str) -> str:
    """SQL: array of (line, level, text) of the ``#`` headings of a Markdown column."""
    # regular expressions run on lines that begin with the mark only
    marked = f"filter(transform(split({_without_code(text)}, '\\n'), (l, i) -> named_struct('i', i + 1, 'l', l)), x -> startswith(x.l, '#'))"
    return rf"""filter(transform({marked}, x -> named_struct(
        'line', x.i,
        'level', length(regexp_extract(x.l, r'^(#{{1,6}})\s+\S', 1)),
        'text', regexp_replace(regexp_extract(x.l, r'^#{{1,6}}\s+(.*)$', 1), r'(?U)\s+#*\s*$|\s+$', ''))),
        h -> h.level > 0)"""


def md_headings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Headings of Markdown documents: (key, line, level, text); fenced code is skipped."""
    return docs.select(key, F.expr(f"inline({headings_of(text)})"))


def md_section(
    docs: DataFrame, query: str, key: str = "doc_id", text: str = "text", max_listed: int | None = None
) -> DataFrame:
    """The section under the first heading containing ``query`` (case-insensitive).

    It ends before the next heading of the same or a higher level.  Result (key, found,
    heading, level, start_line, end_line, section); where nothing matches ``section`` lists
    the headings, at most ``max_listed`` where that is given.
    """
    listed = 2**31 - 1 if max_listed is None else max_listed
    wanted = _quoted(query.lower())
    return (
        docs.withColumn("heads", F.expr(headings_of(text)))
        .withColumn("hit", F.expr(f"get(filter(heads, h -> contains(lower(h.text), {wanted})), 0)"))
        .withColumn(
            "stop",
            F.expr("get(filter(heads, h -> h.line > hit.line AND h.level <= hit.level), 0).line"),
        )
        .select(
            key,
            F.expr("hit IS NOT NULL").alias("found"),
            F.col("hit.text").alias("heading"),
            F.col("hit.level").alias("level"),
            F.col("hit.line").alias("start_line"),
            F.col("stop").alias("end_line"),
            F.expr(
                f"""CASE WHEN hit IS NOT NULL THEN array_join(slice(split({text}, '\\n'), hit.line,
                    coalesce(stop, size(split({text}, '\\n')) + 1) - hit.line), '\\n')
                WHEN size(heads) = 0 THEN '{NO_HEADINGS_ERROR}'
                ELSE concat('{NO_MATCH_ERROR}', {_quoted("'" + query + "'")}, '.\\n\\n{HEADINGS_LISTED}\\n',
                    array_join(transform(slice(heads, 1, {listed}), h -> concat('  - ', h.text)), '\\n'),
                    CASE WHEN size(heads) > {listed} THEN concat('\\n  ... and ', size(heads) - {listed}, ' more') ELSE '' END)
                END"""
            ).alias("section"),
        )
    )


# --------------------------------------------------------------- line search

def _lines(text: str) -> str:
    """SQL: the lines of a text; a final line break does not open another line."""
    return rf"split(regexp_replace({text}, r'\n\z', ''), r'\n')"


def _grep_rows(pattern: str, context_lines: int) -> str:
    """SQL: the shown lines of the array column ``lines`` as (line_no, hit, line).

    The one-element array gives its struct a name inside the lambda, so that the hits are
    found once.
    """
    if context_lines < 0:
        raise ValueError("context_lines must be zero or greater")
    regex, n = _quoted("(?i)" + pattern), context_lines
    hits = f"filter(transform(lines, (l, i) -> CASE WHEN l RLIKE {regex} THEN i END), i -> i IS NOT NULL)"
    shown = (
        f"array_sort(array_distinct(flatten(transform(p.hits, h -> "
        f"sequence(greatest(0, h - {n}), least(size(p.lines) - 1, h + {n}))))))"
    )
    return (
        f"transform(array(named_struct('lines', lines, 'hits', {hits})), p -> transform({shown}, k -> "
        f"named_struct('line_no', k + 1, 'hit', p.lines[k] RLIKE {regex}, 'line', p.lines[k])))[0]"
    )


def grep_context(
    docs: DataFrame,
    pattern: str,
    context_lines: int = GREP_CONTEXT,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Matching lines with ``context_lines`` around each: (key, line_no, hit, line).

    ``pattern`` is a Java regular expression, matched without case.  Everything happens
    inside the row: no exchange, and time linear in the lines of a document.
    """
    return docs.select(key, F.expr(_lines(text)).alias("lines")).select(
        key, F.expr(f"inline({_grep_rows(pattern, context_lines)})")
    )


def grep_report(
    docs: DataFrame,
    pattern: str,
    context_lines: int = GREP_CONTEXT,
    key: str = "doc_id",
    text: str = "text",
    max_chars: int | None = None,
) -> DataFrame:
    """The search listing of each document with a match: (key, report); map-only.

    ``n:line`` for matches, ``n-line`` for context, ``--`` between separate stretches, cut
    at ``max_chars`` where that is given.
    """
    report = "full" if max_chars is None else (
        f"CASE WHEN length(full) > {max_chars} THEN concat(left(full, {max_chars}), '\\n{GREP_CUT}') ELSE full END"
    )
    gap = "i > 0 AND r[i - 1].line_no < x.line_no - 1" if context_lines else "false"
    listing = f"""array_join(transform(r, (x, i) -> concat(CASE WHEN {gap} THEN '--\n' ELSE '' END,
        x.line_no, CASE WHEN x.hit THEN ':' ELSE '-' END, x.line)), '\n')"""
    reports = f"""transform(filter(array({_grep_rows(pattern, context_lines)}), r -> size(r) > 0), r -> {listing})"""
    return (
        docs.select(key, F.expr(_lines(text)).alias("lines"))
        .select(key, F.explode(F.expr(reports)).alias("full"))
        .select(key, F.expr(report).alias("report"))
    )


def grep_literal(
    docs: DataFrame,
    search: str,
    case_sensitive: bool = False,
    max_lines: int | None = None,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The lines (the first ``max_lines``, if given) of each document containing ``search``: (key, line_no, line)."""
    shown = 2**31 - 1 if max_lines is None else max_lines
    fold = (lambda e: e) if case_sensitive else (lambda e: f"lower({e})")
    needle = _quoted(search if case_sensitive else search.lower())
    return docs.where(F.expr(f"contains({fold(text)}, {needle})")).select(
        key,
        F.expr(
            f"inline(slice(filter(transform({_lines(text)}, (l, i) -> named_struct('line_no', i + 1, 'line', l)), "
            f"x -> contains({fold('x.line')}, {needle})), 1, {shown}))"
        ),
    )


# --------------------------------------------------------------- byte slices

def byte_slice(
    docs: DataFrame,
    offset: int = 0,
    limit: int = READ_LIMIT,
    max_bytes: int | None = None,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """UTF-8 bytes ``[offset, offset + limit)`` of a text: (key, n_bytes, slice).

    Characters cut by either edge are dropped.  Texts above ``max_bytes`` give NULL.
    """
    part = f"substring(encode({text}, 'UTF-8'), {offset + 1}, {limit})"
    # hex pairs: continuation bytes at the front, an unfinished sequence at the end
    inner = f"regexp_replace(hex({part}), '^(?:[89AB][0-9A-F])+', '')"
    whole = (
        f"regexp_replace({inner}, "
        "'(?:[CDEF][0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])|F[0-9A-F](?:[89AB][0-9A-F]){1,2})$', '')"
    )
    sliced = F.expr(f"decode(unhex({whole}), 'UTF-8')")
    if max_bytes is not None:
        sliced = F.when(F.octet_length(text) <= max_bytes, sliced)
    return docs.select(key, F.octet_length(text).cast("bigint").alias("n_bytes"), sliced.alias("slice"))


# --------------------------------------------------------------- Markdown tables

def md_table_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of the pipe tables of Markdown documents: (key, section, table_no, row_no, cells).

    ``section`` is the latest ``## `` line; separator rows are dropped; a table needs a row
    besides its header.  Only table and section lines are exchanged, on the document key:
    consecutive line numbers form a table.
    """
    lines = docs.select(
        key,
        F.expr(
            rf"""inline(filter(transform(split({text}, '\n'), (l, i) -> named_struct('line_no', i, 'line', l,
                'section', CASE WHEN startswith(l, '## ') THEN regexp_replace(substring(l, 4), {_TRIM}, '') END,
                'piped', regexp_replace(l, {_TRIM}, '') LIKE '|%')), x -> x.piped OR x.section IS NOT NULL))"""
        ),
    ).repartition(key)
    order = Window.partitionBy(key).orderBy("line_no")
    table = Window.partitionBy(key, "island")
    marked = lines.withColumn("section", F.last("section", ignorenulls=True).over(order)).where("piped")
    islands = marked.withColumn("island", F.col("line_no") - F.row_number().over(order)).where(
        r"NOT line RLIKE r'^\|[-:\s|]+\|$'"
    )
    rows = (
        islands.withColumn("n", F.count("*").over(table))
        .where("n > 1")
        .withColumn("row_no", F.row_number().over(table.orderBy("line_no")))
        .withColumn("table_no", F.dense_rank().over(Window.partitionBy(key).orderBy("island")))
    )
    cells = F.expr(f"transform(split(line, r'\\|'), c -> regexp_replace(c, {_TRIM}, ''))")
    return rows.withColumn("cells", cells).select(
        key,
        "section",
        "table_no",
        "row_no",
        F.expr(
            "slice(cells, CASE WHEN cells[0] = '' THEN 2 ELSE 1 END, greatest(0, size(cells) "
            "- CASE WHEN cells[0] = '' THEN 1 ELSE 0 END "
            "- CASE WHEN size(cells) > 1 AND element_at(cells, -1) = '' THEN 1 ELSE 0 END))"
        ).alias("cells"),
    )


def md_tables_combined(tables: DataFrame, key: str = "doc_id") -> DataFrame:
    """Title row, blank row, table rows and blank row of every table as sortable rows.

    (key, table_no, part, row_no, cells): write it with ``orderBy`` of these, which range
    partitions, so that the part files joined in name order are the combined file.
    """
    section = F.coalesce("section", F.lit("Unknown"))
    head = F.col("row_no") == 1
    title = F.struct(
        F.lit(0).alias("part"), F.lit(0).alias("row_no"),
        F.array(F.concat(F.lit("=== "), section, F.lit(" ==="))).alias("cells"),
    )
    none = F.array().cast("array<string>")
    gap = F.struct(F.lit(1).alias("part"), F.lit(0).alias("row_no"), none.alias("cells"))
    end = F.struct(F.lit(3).alias("part"), F.lit(0).alias("row_no"), none.alias("cells"))
    data = F.struct(F.lit(2).alias("part"), F.col("row_no"), F.col("cells"))
    # the header row brings the three extra rows with it, so no second pass is needed
    return tables.select(
        key,
        "table_no",
        F.inline(F.when(head, F.array(title, gap, data, end)).otherwise(F.array(data))),
    )


# --------------------------------------------------------------- chunks

def _chunk_bounds(text: str, size: int, backoff: int) -> Iterator[tuple[int, int]]:
    at, n = 0, len(text)
    while at < n:
        stop = min(at + size, n)
        if stop < n:
            newline = text.rfind("\n", max(stop - backoff, at), stop)
            if newline > at:
                stop = newline + 1
        yield at, stop
        at = stop


# characters after which the pieces of a run of rows are handed to Spark
_RUN_CHARS = 4_000_000


def _row_pieces(pieces: Callable[[str], list[tuple]], schema: T.StructType):
    """Arrow function of (key, text): the key beside each tuple of ``pieces(text)``."""
    names = schema.fieldNames()
    types = [to_arrow_type(f.dataType) for f in schema.fields[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners: list[int] = []
            found: list[tuple] = []
            chars = 0
            for row in range(batch.num_rows):
                value = batch.column(1)[row].as_py() or ""
                new = pieces(value)
                owners += [row] * len(new)
                found += new
                chars += len(value)
                if found and (chars >= _RUN_CHARS or row == batch.num_rows - 1):
                    columns = [pa.array(c, t) for c, t in zip(zip(*found), types)]
                    owner = batch.column(0).take(pa.array(owners, pa.int64()))
                    yield pa.RecordBatch.from_arrays([owner, *columns], names=names)
                    owners, found, chars = [], [], 0

    return run


def text_chunks(
    docs: DataFrame,
    size: int = CHUNK_CHARS,
    backoff: int = CHUNK_BACKOFF,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Chunks of at most ``size`` characters: (key, chunk_no, start, end, size, chunk).

    A chunk ends after the last line break among its final ``backoff`` characters.  Each
    cut depends on the one before, so this is one of the Python steps; rows stay where
    they are.
    """
    field = docs.schema[key]
    schema = T.StructType(
        [field] + T.StructType.fromDDL(
            "chunk_no int, start bigint, end bigint, size int, chunk string"
        ).fields
    )

    def pieces(value: str) -> list[tuple]:
        bounds = _chunk_bounds(value, size, backoff)
        return [(n, a, b, b - a, value[a:b]) for n, (a, b) in enumerate(bounds, 1)]

    return docs.select(key, text).mapInArrow(_row_pieces(pieces, schema), schema)


def pack_pieces(pages: DataFrame, key: str, html: str, limit: int) -> DataFrame:
    """Cut markup between its pieces into chunks of at most ``limit`` characters, filled greedily.

    Text longer than the limit is cut by characters; a tag, comment or script longer than it stays
    whole and makes a longer chunk.
    """
    from tabledoc.operators.html_tree import markup_pieces

    schema = T.StructType(
        [pages.schema[key]] + T.StructType.fromDDL("chunk_no int, chunk string").fields
    )

    def pieces(page: str) -> list[tuple]:
        ends, at = [], 0  # ends of the chunks; where the open one began
        for start, end, is_text in markup_pieces(page) if len(page) > limit else ():
            if end - at > limit and start > at:
                ends.append(start)
                at = start
            while is_text and end - at > limit:
                at += limit
                ends.append(at)
        ends.append(len(page))
        return [(n, page[a:b]) for n, (a, b) in enumerate(zip([0, *ends], ends), 1) if a < b or n == 1]

    return pages.select(key, html).mapInArrow(_row_pieces(pieces, schema), schema)


def map_text(
    rows: DataFrame, fn: Callable[[str], str], text: str = "chunk", out: str = "result"
) -> DataFrame:
    """Apply a user function to every text; an exception becomes the row's result."""
    schema = T.StructType(rows.schema.fields + [T.StructField(out, T.StringType())])

    def one(value: str) -> str:
        try:
            return fn(value)
        except Exception as err:  # the row carries its error, the job goes on
            return f"{CHUNK_ERROR}{err}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch[out] = [one(v) for v in batch[text]]
            yield batch

    return rows.mapInPandas(run, schema)


def find_in_chunks(chunks: DataFrame, pattern: str, text: str = "chunk", out: str = "result") -> DataFrame:
    """The default finder: the distinct matches of ``pattern``, or the no-result sentence."""
    regex = _quoted("(?i)" + pattern)
    found = F.expr(f"array_sort(array_distinct(regexp_extract_all({text}, {regex}, 0)))")
    return chunks.withColumn(
        out,
        F.when(F.size(found) > 0, F.array_join(found, ", ")).otherwise(
            NO_RESULT
        ),
    )


def carries_result(result: str = "result"):
    """Whether a chunk result says more than that nothing was found."""
    return ~F.contains(F.lower(F.col(result)), F.lit(NOTHING_FOUND))


def merge_chunks(chunks: DataFrame, key: str = "doc_id", result: str = "result") -> DataFrame:
    """Results of a document's chunks in order: (key, n_results, merged)."""
    line = F.concat(
        F.lit(CHUNK_TITLE), F.col("chunk_no"), F.lit(CHUNK_CHARACTERS), F.col("start"), F.lit("-"),
        F.col("end"), F.lit(f"{CHUNK_TITLE_END}\n"), F.col(result), F.lit("\n"),
    )
    found = chunks.where(carries_result(result)).select(key, "chunk_no", line.alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct("chunk_no", "line")))
    return found.groupBy(key).agg(
        F.count("*").alias("n_results"),
        F.array_join(F.transform(ordered, lambda r: r["line"]), "").alias("merged"),
    )
