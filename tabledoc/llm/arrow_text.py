"""Text columns of Arrow batches as numpy arrays, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text worked on at a time; a longer text is worked on alone.
SLICE_BYTES = 1 << 20
#: Rows of an Arrow batch between Spark and its Python workers.
BATCH_ROWS = "1000"


def in_small_batches(docs: DataFrame) -> DataFrame:
    """The same rows, with the session set to batches that stay small for long texts."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return docs


def aside(docs: DataFrame, used: list[str], kept: list[str] | None = None) -> tuple[DataFrame, list[Column]]:
    """The rows with all columns but ``used`` under plain names no operator makes, and the columns as they were.

    Arrow functions do not take columns with a dot in their names.  ``kept`` are the columns to go on with, all by default.
    """
    names = {c: c if c in used else f"_kept_{i}" for i, c in enumerate(docs.columns) if kept is None or c in kept or c in used}
    back = [F.col(x).alias(c) for c, x in names.items() if kept is None or c in kept]
    return docs.select(*[F.col(f"`{c}`").alias(x) for c, x in names.items()]), back


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (rows + 1, from 0) and UTF-8 bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def slices(batch: pa.RecordBatch, name: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple]:
    """Runs of rows with at most ``limit`` bytes of text: (rows, offsets, bytes)."""
    offsets, data = utf8(batch.column(batch.schema.get_field_index(name)))
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at), offsets[at : to + 1] - offsets[at], data[offsets[at] : offsets[to]]
        at = to


def codepoints(data: np.ndarray) -> np.ndarray:
    """Code points of UTF-8 bytes."""
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)


def char_offsets(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Byte offsets as code-point offsets."""
    starts = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return starts[offsets]


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and the rows' offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))
