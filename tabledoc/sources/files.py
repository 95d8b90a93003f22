"""Pages, images and listings read from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabledoc.functions.expressions import page_id

# ---- fixed values: the image types accepted by extension, and the text for others ----
UNSUPPORTED_IMAGE = ("Unsupported image type: .", ". Supported: ")
IMAGE_TYPES = {
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "gif": "image/gif",
    "webp": "image/webp",
    "bmp": "image/bmp",
}


# windows-1252 is ISO-8859-1 but for the bytes 0x80 to 0x9F, of which five are undefined
_C1 = "".join(map(chr, range(0x80, 0xA0)))
_CP1252 = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0))


def decode_bytes(content: Column | str) -> Column:
    """Page bytes as text: UTF-8 where they are valid UTF-8, else windows-1252."""
    col = F.col(content) if isinstance(content, str) else content
    text = col.cast("string")
    single = F.translate(F.decode(col, "ISO-8859-1"), _C1, _CP1252)
    return F.when(F.is_valid_utf8(text), text).otherwise(single)


def read_binary(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Files as (path, modificationTime, length, content)."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    )


def load_pages(pages: DataFrame, *keep: str) -> DataFrame:
    """Page records: (keep, data_id, url, html_size, html).  Markup is not read unless asked for."""
    return pages.select(
        *keep, page_id("url").alias("data_id"), "url", F.length("html").alias("html_size"), "html"
    )


def list_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Directory listing: (kind, name, size), directories from the paths of the files below.

    Only file status is read; the content column is pruned.
    """
    root = "/" + path.strip("/") + "/"
    inner = F.regexp_replace("path", r"^[a-z0-9]+:/*", "/")
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select(inner.alias("path"), "length")
        .select(F.expr(f"substring(path, length('{root}') + 1)").alias("rel"), "length")
    )
    nested = F.contains("rel", F.lit("/"))
    files = found.where(F.lit(recursive) | ~nested).select(
        F.lit("file").alias("kind"), F.col("rel").alias("name"), F.col("length").alias("size")
    )
    if recursive:
        parents = F.explode(
            F.expr("transform(sequence(1, size(split(rel, '/')) - 1), i -> array_join(slice(split(rel, '/'), 1, i), '/'))")
        )
    else:
        parents = F.substring_index("rel", "/", 1)
    dirs = (
        found.where(nested)
        .select(parents.alias("name"), "length")
        .groupBy("name")
        .agg(F.sum("length").alias("size"))
        .select(F.lit("dir").alias("kind"), "name", "size")
    )
    return dirs.unionByName(files)


def ingest_images(files: DataFrame) -> DataFrame:
    """(path, content) -> (path, mime_type, size_kb, base64_data, error); map-only."""
    extension = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    kinds = F.create_map(*[F.lit(x) for pair in IMAGE_TYPES.items() for x in pair])
    mime = F.element_at(kinds, extension)
    known = mime.isNotNull()
    supported = ", ".join(f".{k}" for k in IMAGE_TYPES)
    return files.select(
        "path",
        mime.alias("mime_type"),
        F.when(known, F.length("content") / 1024).alias("size_kb"),
        F.when(known, F.translate(F.base64("content"), "\r\n", "")).alias("base64_data"),
        F.when(
            ~known,
            F.concat(F.lit(UNSUPPORTED_IMAGE[0]), extension, F.lit(f"{UNSUPPORTED_IMAGE[1]}{supported}")),
        ).alias("error"),
    )


def read_ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a distributed export with their number: (line_no, line), as if its files were joined by name.

    A line's number is its place in its split plus the lines of the splits before it, of which there is one row each.
    """
    split = ["file", "block"]
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").alias("line"), F.monotonically_increasing_id().alias("at"),
    )
    # a split is read by one task from its start, so its ids follow each other
    splits = lines.groupBy(*split).agg(F.count("*").alias("n"), F.min("at").alias("low"))
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select(*split, (F.coalesce(F.sum("n").over(before), F.lit(0)) + 1 - F.col("low")).alias("shift"))
    return lines.join(starts, split).select((F.col("at") + F.col("shift")).alias("line_no"), "line")
