"""Delimited text as all-string tables."""

from __future__ import annotations

import csv
import io
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabledoc.functions.expressions import short_id

# ---- fixed values of the delimited reader ----
DELIMITERS = (",", ";", "\t", "|", ":")
QUOTES = ('"', "'")
SAMPLE_CHARS = 32_768
SAMPLE_LINES = 200
PREVIEW_ROWS = 5


def _plain_path(path: str) -> str:
    """A path without scheme and host, as the files below it are compared with it."""
    return re.sub(r"^[A-Za-z][\w+.-]*:(//[^/]*)?", "", path).rstrip("/") or "/"


def _pattern(path: str) -> str:
    """Regular expression of the files that a path, which may have wildcards, names."""
    wild = {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")", ",": "|"}
    out, depth = "", 0
    for c in _plain_path(path):
        depth += (c == "{") - (c == "}")
        out += wild[c] if c in wild and (c != "," or depth) else c if c in "[]-" else re.escape(c)
    return f"^{out}(?:/.*)?$"


def _path_of(file: Column, paths: list[str]) -> Column:
    """The first of the paths that names a file."""
    plain = F.url_decode(F.replace(F.regexp_replace(file, r"^[A-Za-z][\w+.-]*:(//[^/]*)?", ""), F.lit("+"), F.lit("%2B")))
    return F.coalesce(*[F.when(plain.rlike(_pattern(p)), F.lit(p)) for p in paths])


def _heads(spark: SparkSession, paths: list[str], chars: int, lines: int) -> DataFrame:
    """The first lines of the first file of each path that are not blank, at most so many characters: (path, lines).

    One listing and one scan of those files, whatever the number of paths; a file's first lines are the first rows of
    its first block.
    """
    paths = list(dict.fromkeys(paths))
    found = spark.read.format("binaryFile").load(paths).where("length > 0").select("path")
    # one row for each path
    first = [r["path"] for r in found.groupBy(_path_of(F.col("path"), paths).alias("p")).agg(F.min("path").alias("path")).collect()]
    if not first:
        return spark.createDataFrame([], "path string, lines array<string>")
    text = spark.read.text(first).select(
        _path_of(F.col("_metadata.file_path"), paths).alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line")
    )
    order = Window.partitionBy("path").orderBy("at")
    numbered = text.withColumn("at", F.monotonically_increasing_id()).where("block = 0").withColumn("n", F.row_number().over(order) - 1)
    before = F.coalesce(F.sum(F.length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = numbered.where(F.col("n") < lines).withColumn("room", F.lit(chars) - before).where("room > 0")
    line = F.struct("n", F.expr("left(line, CAST(room AS int))").alias("line"))
    # one row for each path, of at most `lines` lines
    gathered = cut.groupBy("path").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return gathered.select("path", F.filter(F.transform("lines", lambda x: x["line"]), lambda x: F.trim(x) != "").alias("lines"))


def _bare(text: Column, quote: str, delimiter: str | None = None) -> Column:
    """A text without its quoted cells, so that delimiters and line breaks in them do not count.

    A quote opens a cell only at a delimiter (any candidate, if none is given) or line border.
    """
    cut = "\\Q" + delimiter + "\\E" if delimiter else "[" + "".join(DELIMITERS) + "]"
    pattern = f"(?m)(^|{cut}){quote}(?:[^{quote}]|{quote}{quote})*+{quote}(?=\\r?$|{cut})"
    return F.regexp_replace(text, F.lit(pattern), F.lit("$1"))


def _cells(line: Column, delimiter: Column, quote: Column) -> Column:
    """The cells of a line as an array, by the delimiter and quote of its row; quotes are taken off."""
    # a cell is quoted (quotes inside are doubled) or runs to the next delimiter
    edge = F.concat(F.lit("\\Q"), delimiter, F.lit("\\E"))
    quoted = F.concat(quote, F.lit("((?:[^"), quote, F.lit("]|"), quote, quote, F.lit(")*+)"), quote, F.lit("(?=$|"), edge, F.lit(")"))
    pattern = F.concat(edge, F.lit("(?:("), quoted, F.lit(")|((?:(?!"), edge, F.lit(").)*+))"))
    whole, inner, free = (F.regexp_extract_all(F.concat(delimiter, line), pattern, F.lit(i)) for i in (1, 2, 3))
    cell = lambda pair, c: F.when(F.length(pair["w"]) > 0, F.replace(pair["i"], F.concat(quote, quote), quote)).otherwise(c)
    return F.zip_with(F.zip_with(whole, inner, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), free, cell)


def csv_dialects(
    spark: SparkSession, paths: list[str], sample_chars: int = SAMPLE_CHARS, sample_lines: int = SAMPLE_LINES
) -> DataFrame:
    """Delimiter, quote and header flag of each path: (path, delimiter, quote, has_header).

    Looks at the head of the first file of each path, at most ``sample_chars`` characters and ``sample_lines`` lines.  The
    delimiter is the candidate whose most usual count in a line is that of the largest share of lines, so a few
    ragged lines do not rule it out; of equal shares the first candidate, a comma where there is none.  The first line is a
    header unless its cells look like those below them: each column whose cells below are all numbers, or all have one shape with
    a number in it, votes by whether the first line's cell has it too.
    """
    head = _heads(spark, paths, sample_chars, sample_lines)
    bare = head.withColumn("bare", F.transform("lines", lambda x: _bare(_bare(x, '"'), "'")))

    def fit(rank: int, d: str) -> Column:
        """The modal count of a candidate in the lines that have it, as (lines with that count, preference, count, candidate)."""
        counts = F.filter(F.transform("bare", lambda x: F.length(x) - F.length(F.replace(x, F.lit(d), F.lit("")))), lambda k: k > 0)
        mode = lambda k: F.struct(
            F.size(F.filter(counts, lambda x: x == k)).alias("n"), F.lit(-rank).alias("rank"), k.alias("k"), F.lit(d).alias("d")
        )
        return F.array_max(F.transform(F.array_distinct(counts), mode))

    best = F.array_max(F.array_compact(F.array(*[fit(i, d) for i, d in enumerate(DELIMITERS)])))["d"]
    single = r"(?:^|[,;\t|:])'[^']*'(?:[,;\t|:]|$)"
    double = r"(?:^|[,;\t|:])\"[^\"]*\"(?:[,;\t|:]|$)"
    like = lambda pattern: F.size(F.filter("lines", lambda x: x.rlike(pattern)))
    known = bare.select(
        "path", "lines", F.coalesce(best, F.lit(",")).alias("delimiter"), F.when(like(single) > like(double), "'").otherwise('"').alias("quote")
    )

    def shape(cell: Column) -> Column:
        """Numbers and words of a cell by their kind only."""
        kinds = F.regexp_replace(F.regexp_replace(F.trim(cell), r"\p{L}+", "a"), r"[0-9]+", "9")
        return F.when(F.trim(cell).try_cast("double").isNotNull(), "9").otherwise(kinds)

    shaped = known.withColumn("shapes", F.transform("lines", lambda x: F.transform(_cells(x, F.col("delimiter"), F.col("quote")), shape)))
    # a column votes where all cells below the first line have one shape, and that holds a number
    below = F.slice("shapes", 2, F.size("shapes"))

    def vote(cell: Column, c: Column) -> Column:
        rest = F.array_compact(F.transform(below, lambda row: F.get(row, c)))
        told = (F.size(rest) > 0) & (F.array_min(rest) == F.array_max(rest)) & F.array_min(rest).contains("9")
        return F.when(~F.coalesce(told, F.lit(False)), 0).when(cell == F.array_min(rest), -1).otherwise(1)

    votes = F.aggregate(F.transform(F.get("shapes", F.lit(0)), vote), F.lit(0), lambda a, x: a + x)
    # one row for each path asked for
    found = {r["path"]: r for r in shaped.select("path", "delimiter", "quote", F.coalesce(votes >= 0, F.lit(True)).alias("has_header")).collect()}
    rows = [(p, *(tuple(found[p])[1:] if p in found else (",", '"', True))) for p in paths]
    return spark.createDataFrame(rows, "path string, delimiter string, quote string, has_header boolean")


def measure(spark: SparkSession, path: str, delimiter: str, quote: str = '"', multiline: bool = False) -> tuple[int, int, int]:
    """Cells of the longest row, lines that are not blank and files that have one, by one scan.

    With ``multiline`` a file is one text.
    """
    lines = spark.read.text(path, wholetext=multiline).select("_metadata.file_path", _bare(F.col("value"), quote, delimiter).alias("bare"), "value")
    if multiline:
        lines = lines.select("file_path", F.explode(F.split("bare", "\n")).alias("bare"), F.col("bare").alias("value"))
    k = F.length("bare") - F.length(F.replace("bare", F.lit(delimiter), F.lit("")))
    full = F.col("value").rlike(r"[^\x00-\x20]")
    files = lines.groupBy("file_path").agg(F.max(k).alias("k"), F.count_if(full).alias("n"))
    found = files.agg(F.max("k").alias("k"), F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("files")).first()
    return (0 if found["k"] is None else found["k"] // len(delimiter) + 1), found["n"] or 0, found["files"]


def header_cells(spark: SparkSession, path: str) -> DataFrame:
    """The names in the header line of a path, in order: (position, name); none without a header."""
    first = _heads(spark, [path], 2**31 - 1, SAMPLE_LINES).select("path", F.get("lines", F.lit(0)).alias("line"))
    known = csv_dialects(spark, [path]).where("has_header")
    cells = first.join(F.broadcast(known), "path").select(F.posexplode(_cells(F.col("line"), F.col("delimiter"), F.col("quote"))).alias("position", "name"))
    return cells.select("position", F.trim("name").alias("name"))


def split_lines(spark: SparkSession, dialects: DataFrame) -> DataFrame:
    """Lines of many paths, each split by its own dialect, as one scan: (path, cells).

    ``dialects`` is a result of ``csv_dialects``; header lines and blank lines are left out, quotes are taken off.  Tables
    of different shapes have no common columns, so a row is an array of cells.
    """
    paths = [r["path"] for r in dialects.select("path").collect()]  # the paths asked for
    lines = spark.read.text(paths).select(
        _path_of(F.col("_metadata.file_path"), paths).alias("path"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("at"),
    ).where(F.col("line").rlike(r"[^\x00-\x20]"))
    lines = lines.join(F.broadcast(dialects), "path")
    # the first line of every file, kept as one row of each
    first = lines.where("block = 0 AND has_header").groupBy("file").agg(F.min("at").alias("at"))
    rows = lines.join(first, ["file", "at"], "left_anti")
    return rows.select("path", _cells(F.col("line"), F.col("delimiter"), F.col("quote")).alias("cells"))


def _names(first_line: str | None, delimiter: str, quote: str, header: bool, width: int) -> list[str]:
    cells: list[str] = []
    if header and first_line:
        cells = next(csv.reader(io.StringIO(first_line), delimiter=delimiter, quotechar=quote), [])
    names: list[str] = []
    for i in range(max(width, len(cells))):
        name = cells[i].strip() if i < len(cells) and cells[i].strip() else f"column{i}"
        base, k = name, 0
        while name.lower() in {n.lower() for n in names}:
            k += 1
            name = f"{base}_{k}"
        names.append(name)
    return names


def read_delimited(
    spark: SparkSession,
    path: str,
    delimiter: str = ",",
    quote: str = '"',
    header: bool = True,
    width: int | None = None,
    multiline: bool = False,
) -> DataFrame:
    """All columns as strings; short rows are padded, long rows widen the table.

    ``width`` skips the scan for the widest row.  ``multiline`` accepts line breaks inside
    quotes; files are then no longer split, so leave it off for large ones.
    """
    if width is None:
        width = measure(spark, path, delimiter, quote, multiline)[0]
    first = spark.read.text(path).head()
    names = _names(first["value"] if first else None, delimiter, quote, header, width)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.csv(
        path, schema=schema, sep=delimiter, quote=quote, escape=quote, header=header,
        multiLine=multiline, mode="PERMISSIVE",
    )


def load_delimited(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Detect, read, register and describe one path: (table, one-row entry).

    The table is registered as a view named by its id, which is derived from path, size and
    modification time.
    """
    dialect = csv_dialects(spark, [path]).first()
    width, lines, files = measure(spark, path, dialect["delimiter"], dialect["quote"])
    table = read_delimited(spark, path, dialect["delimiter"], dialect["quote"], dialect["has_header"], width)
    # every file has the header line
    rows = lines - files if dialect["has_header"] else lines
    found = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path).agg(
        F.coalesce(F.sum("length"), F.lit(0)).alias("size"),
        F.max("modificationTime").alias("changed"),
    )
    entry = found.select(
        short_id("csv_", F.lit(path), F.lit(":"), F.col("size").cast("string"), F.lit(":"), F.col("changed").cast("string")).alias("data_id"),
        F.lit("csv_table").alias("data_type"),
        F.lit(path).alias("path"),
        F.lit(rows).cast("bigint").alias("rows"),
        F.lit(len(table.columns)).alias("columns"),
        F.lit(", ".join(table.columns)).alias("column_names"),
        F.col("size").alias("file_size_bytes"),
        F.lit(dialect["delimiter"]).alias("delimiter"),
        F.lit(dialect["quote"]).alias("quote"),
        F.lit(dialect["has_header"]).alias("has_header"),
    )
    stamp = entry.first()
    table.createOrReplaceTempView(stamp["data_id"])
    return table, spark.createDataFrame([stamp], entry.schema)


def preview(table: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows; stops reading when it has them."""
    return table.limit(rows)
