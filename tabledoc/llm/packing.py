"""Best-fit packing of token sequences after a Martello-Toth dominance reduction.

Only the length of a piece matters for packing, and a length is at most the capacity.  So the
instance is a histogram of at most ``capacity`` counts, whatever the number of documents, and
the plan is a list of runs: "the pieces of length l with ranks from a on go, q each, into the
sequences from s on, at offset o".  The driver sees the histogram and makes the plan; numbering
the pieces of a length and looking up their run is done by Spark, with no task for a whole length.
"""

from __future__ import annotations

import itertools
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabledoc.llm.arrow_text import in_small_batches, list_array, slices
from tabledoc.session import materialise

#: Cached words per worker; the cache is emptied when full (results do not depend on it).
CACHE_WORDS = 800_000
#: Letters that are their own composed form and lower-case one by one, then ASCII marks but the apostrophe.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+)([!-&(-/:;=?@\\[-`{}~]*)")


class _Words:
    """Ids of words as little-endian unsigned 32-bit bytes, cached."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.model, self.symbol = self.tokenizer.model, _byte_symbols()
        # Where the library agrees on samples, words of plain letters and punctuation go to its model
        # directly, without its normalising and splitting, which cost more than the merges.
        self.plain = True
        tried = ["Plain", "word,", "\u00c9t\u00e9...", "stra\u00dfe|", "\u010c\u017eX!?", "re.", "s"]
        self.plain = self._encode([x.encode() for x in tried]) == [
            array("I", self.tokenizer.encode(x, add_special_tokens=False).ids).tobytes() for x in tried
        ]

    def ids(self, words: list[bytes]) -> list[bytes]:
        got = list(map(self.known.get, words))
        if None in got:
            at = [i for i, x in enumerate(got) if x is None]
            new = list({words[i] for i in at})
            fresh = dict(zip(new, self._encode(new)))
            for i in at:
                got[i] = fresh[words[i]]
            if len(self.known) + len(fresh) > CACHE_WORDS:
                self.known.clear()
            self.known.update((w, x) for w, x in fresh.items() if len(w) <= 64)
        return got

    def _encode(self, words: list[bytes]) -> list[bytes]:
        out = []
        for word in words:
            text = word.decode("utf-8")
            if self.plain and (m := _PLAIN.fullmatch(text)):
                letters, rest = m.groups()
                ids = self._model(letters.lower())
                out.append(ids + self._model(rest) if rest else ids)
            else:
                out.append(array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes())
        return out

    def _model(self, part: str) -> bytes:
        """Ids of one pre-token: its bytes as the symbols of the byte-level alphabet, merged by the model."""
        key = part.encode("utf-8")
        ids = self.known.get(key)
        if ids is None:
            symbols = part if part.isascii() else "".join(map(self.symbol.__getitem__, key))
            ids = array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()
        return ids


def _byte_symbols() -> list[str]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in own}
    for b in range(256):
        table.setdefault(b, chr(0x100 + len(table) - len(own)))
    return [table[b] for b in range(256)]


@lru_cache(2)
def _words(path: str) -> _Words:
    return _Words(path)


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, key: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """Pieces of all documents: ``doc_id, piece, start, length, ids_crc32, ids`` (``ids`` null unless ``keep_ids``).

    A document's ids are those of the tokenizer file without special tokens added, then ``end_id``.
    The tokenizer must drop ASCII white space before it merges, so that words are encoded alone and
    their ids kept in a cache.  A null or empty text is ``end_id`` alone.  Documents longer than
    ``capacity`` are cut into pieces of that length, of which the last may be shorter.
    Rows that repeat an id are documents of their own.  Row-local: no exchange.
    """
    df = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(tokenizer)
        last = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for rows, offsets, data in slices(batch, "text"):
                raw, at = data.tobytes(), offsets.tolist()
                split = [raw[a:b].split() for a, b in zip(at, at[1:])]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in split]))).tolist()
                got = words.ids(list(itertools.chain.from_iterable(split)))
                of_row, piece, start, length, crc, kept = [], [], [], [], [], []
                for i in range(len(at) - 1):
                    ids = b"".join(got[ends[i] : ends[i + 1]]) + last
                    for n, a in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[a : a + 4 * capacity]
                        of_row.append(i)
                        piece.append(n)
                        start.append(a // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        kept.append(part)
                if keep_ids:
                    ids = list_array(np.frombuffer(b"".join(kept), "<i4"), np.concatenate(([0], np.cumsum(length))), pa.int32())
                else:
                    ids = pa.nulls(len(piece), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0).take(pa.array(of_row, pa.int64())),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64()),
                        ids,
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"],
                )

    kind = df.schema["doc_id"].dataType.simpleString()
    return in_small_batches(df).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids array<int>")


class _Plan:
    """Runs of pieces placed so far, and how many pieces of each length are left."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {n: c for n, c in counts.items() if c > 0}
        self.lengths = sorted(self.left)
        self.taken = dict.fromkeys(self.left, 0)
        self.rows: list[tuple[int, int, int, int, int]] = []  # length, first rank, first sequence, pieces each, offset
        self.sequences = 0

    def place(self, length: int, sequence: int, bins: int, each: int, offset: int, pieces: int | None = None) -> None:
        pieces = bins * each if pieces is None else pieces
        self.rows.append((length, self.taken[length], sequence, each, offset))
        self.taken[length] += pieces
        self.left[length] -= pieces
        if not self.left[length]:
            del self.left[length]
            self.lengths.pop(bisect_left(self.lengths, length))

    def largest(self, room: int, held: dict[int, int]) -> int:
        """Largest length up to ``room`` of which more is left than ``held``; 0 if none."""
        at = bisect_left(self.lengths, room + 1)
        while at:
            at -= 1
            if self.left[self.lengths[at]] > held.get(self.lengths[at], 0):
                return self.lengths[at]
        return 0

    def smallest(self, n: int, held: dict[int, int]) -> list[int]:
        """The ``n`` smallest pieces (fewer if there are fewer) besides those held."""
        out: list[int] = []
        for x in self.lengths:
            out += [x] * min(n - len(out), self.left[x] - held.get(x, 0))
            if len(out) >= n:
                break
        return out

    def fix(self, group: list[int]) -> None:
        """As many sequences of exactly this group as its counts allow."""
        need = {x: group.count(x) for x in group}
        bins = min(self.left[x] // n for x, n in need.items())
        offset = 0
        for x, n in need.items():
            self.place(x, self.sequences, bins, n, offset)
            offset += n * x
        self.sequences += bins


def _dominating(plan: _Plan, w: int) -> list[int] | None:
    """A set with a piece of length ``w`` that dominates every other set with one, if that can be shown.

    Set A dominates B if B's pieces can be split into parts, each no longer than another piece of A:
    a solution with B can then be changed into one with A and as many sequences.
    """
    room, held = plan.capacity - w, {w: 1}
    a = plan.largest(room, held)
    if not a:
        return [w]  # nothing fits beside it
    if a == room:
        return [w, a]  # exact: all that fits beside w is together no longer than a
    least = plan.smallest(3, held)
    if len(least) < 2 or least[0] + least[1] > room:
        return [w, a]  # only single pieces fit, none longer than a
    if len(least) == 3 and sum(least) <= room:
        return None
    # at most two fit beside w
    best, second = 0, 0
    for x in plan.lengths:
        if plan.left[x] > held.get(x, 0):
            y = plan.largest(min(x, room - x), {**held, x: held.get(x, 0) + 1})  # the shorter of a pair
            if y:
                best, second = max(best, x + y), max(second, y)
        if 2 * x > room and x > a:
            break
    if a >= best:
        return [w, a]  # no pair is together longer than a
    y = plan.largest(room - a, {**held, a: held.get(a, 0) + 1})
    if y and y >= second:
        return [w, a, y]  # of any pair the longer is no longer than a, the shorter no longer than y
    return None


def plan_packing(counts: dict[int, int], capacity: int = 4096) -> tuple[np.ndarray, int, int]:
    """Runs ``(length, first rank, first sequence, pieces each, offset)``, sequences, and how many are fixed.

    First the reduction: from the longest piece down, groups that provably dominate every other way
    to pack that piece are fixed for good, until no more are found.  Then best fit of the rest in
    descending length: equal pieces go together into the fullest sequences with room for them.
    """
    if any(n > capacity or n < 1 for n in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    plan = _Plan(counts, capacity)
    again = True
    while again:
        again = False
        for w in sorted(plan.left, reverse=True):
            while w in plan.left and (group := _dominating(plan, w)):
                plan.fix(group)
                again = True
    fixed = plan.sequences
    open_runs: dict[int, list[tuple[int, int]]] = {}  # room -> runs of sequences (first, how many)
    rooms: list[int] = []
    for length in sorted(plan.left, reverse=True):
        while left := plan.left.get(length, 0):
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, bins = open_runs[room].pop()
                if not open_runs[room]:
                    del open_runs[room]
                    rooms.pop(at)
            else:
                room, first = capacity, plan.sequences
                bins = -(-left // (capacity // length))
                plan.sequences += bins
            each = room // length
            full = min(bins, left // each)
            rest = left - full * each if full < bins else 0
            plan.place(length, first, full + (rest > 0), each, capacity - room, full * each + rest)
            for start, n, now in ((first, full, room - each * length), (first + full, int(rest > 0), room - rest * length), (first + full + (rest > 0), bins - full - (rest > 0), room)):
                if n and now:
                    if now not in open_runs:
                        open_runs[now] = []
                        insort(rooms, now)
                    open_runs[now].append((start, n))
    return np.array(sorted(plan.rows), np.int64).reshape(-1, 5), plan.sequences, fixed


def pack(pieces: DataFrame, capacity: int = 4096, salts: int = 256) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (``doc_id, piece, length`` and more columns).

    Sequences are at most ``capacity`` long and filled without gaps from 0.  ``pieces`` is read
    twice, so pass a written table.  The pieces of a length are numbered in ``salts`` shares, so a
    length that most documents have is not ordered in one task; ties are ordered by the id.
    No piece is dropped; null ids are ids like others; an empty table gives an empty result.
    """
    spark = pieces.sparkSession
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    runs, _, _ = plan_packing(counts, capacity)
    shared = spark.sparkContext.broadcast(runs)  # some runs for each length, whatever the number of pieces
    share = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int")
    salted = pieces.withColumn("_share", share)
    firsts = salted.groupBy("length", "_share").count().withColumn(
        "_first", F.sum("count").over(Window.partitionBy("length").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1))
    )
    number = F.row_number().over(Window.partitionBy("length", "_share").orderBy("doc_id", "piece")) - 1
    ranked = (
        salted.withColumn("_number", number)
        .join(firsts.select("length", "_share", "_first"), ["length", "_share"])
        .withColumn("_rank", (F.col("_number") + F.coalesce("_first", F.lit(0))).cast("long"))
        .select(*pieces.columns, "_rank")
    )
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        keys = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            row = table[np.searchsorted(keys, length << 44 | rank, "right") - 1]
            at = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(row[:, 2] + at // row[:, 3]), pa.array(row[:, 4] + at % row[:, 3] * length)],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of every document."""
    cut = cut_pieces(docs, tokenizer, end_id, capacity, key, text, keep_ids=False).drop("ids")
    return pack(materialise(cut, "pieces"), capacity)
