"""Byte-level BPE: encoding with vectorised pre-tokenisation, decoding by retained offsets.

Pre-tokenisation uses no regex.  Every code point is mapped to a class; a class is a function
on the states of a small automaton, and the state before each code point is the composition of
all functions before it.  Composition is associative, so it is computed as a scan by doubling
over the ids of the automaton's (finite) transition monoid; the scan ends as soon as all
compositions are constant, which for this pattern takes a few steps.  Boundaries are then a
table look-up of state, class and next class.  The slices are merged by rank, with a cache.
"""

from __future__ import annotations

import base64
import heapq
import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabledoc.llm.arrow_text import aside, codepoints, in_small_batches, list_array, slices

# Classes of code points.  Letters that can follow an apostrophe have classes of their own.
LETTER, NUMBER, OTHER, APOSTROPHE, BLANK, SPACE, ONE, R, V, L, E, BREAK = range(12)
#: Kinds for boundaries: letter, number, other, white space, end of a text.
KIND = np.array([0, 1, 2, 2, 3, 3, 0, 0, 0, 0, 0, 4], np.uint8)
# States: what the last code point was.
START, IN_L, IN_N, IN_O, AFTER_BLANK, AFTER_SPACE, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, DONE1, DONE2 = range(12)
#: Cached slices per worker; the cache is emptied when full (results do not depend on it).
CACHE_SLICES = 300_000
#: Slices up to so many bytes are merged without a heap.
SHORT = 64
NEVER = 1 << 60


def _step(state: int, kind: int) -> int:
    if kind == BREAK:
        return START
    if kind == NUMBER:
        return IN_N
    if kind == OTHER:
        return IN_O
    if kind == BLANK:
        return AFTER_BLANK
    if kind == SPACE:
        return AFTER_SPACE
    if kind == APOSTROPHE:
        return IN_O if state in (IN_O, QUOTE, AFTER_BLANK) else QUOTE
    if state == QUOTE:
        return {ONE: DONE1, R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}.get(kind, IN_L)
    if (state in (QUOTE_R, QUOTE_V) and kind == E) or (state == QUOTE_L and kind == L):
        return DONE2
    return IN_L


@lru_cache(1)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the automaton: id of each class's function, products, results from START, which are constant."""
    functions = {tuple(_step(s, c) for s in range(12)): 0 for c in range(12)}
    work = list(functions)
    generators = list(functions)
    while work:  # close under composition
        f = work.pop()
        for g in generators:
            h = tuple(g[x] for x in f)
            if h not in functions:
                functions[h] = 0
                work.append(h)
    table = list(functions)
    number = {f: i for i, f in enumerate(table)}
    product = np.array([[number[tuple(g[x] for x in f)] for g in table] for f in table], np.uint16)
    generator = np.array([number[tuple(_step(s, c) for s in range(12))] for c in range(12)], np.uint16)
    return generator, product, np.array([f[START] for f in table], np.uint8), np.array([len(set(f)) == 1 for f in table])


def states_before(classes: np.ndarray) -> np.ndarray:
    """State of the automaton before each code point, by an associative scan."""
    generator, product, from_start, constant = monoid()
    scan, width, n = generator[classes], 1, len(classes)
    while width < n and not constant[scan[width:]].all():
        # scan[i] composes the last `width` functions up to i; doubled by its left neighbour
        scan = np.concatenate((scan[:width], product[scan[:-width], scan[width:]]))
        width *= 2
    out = np.empty(n, np.uint8)
    out[:1] = START
    out[1:] = from_start[scan[:-1]]
    return out


def class_table() -> np.ndarray:
    """Class of every code point, as the installed tokenizer library's pattern engine sees it."""
    import tiktoken

    every = "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))))
    single = {bytes([i]): i for i in range(256)}
    table = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        found = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        text = found.decode_bytes(found.encode_ordinary(every))
        table[codepoints(np.frombuffer(text, np.uint8))] = kind
    for chars, kind in (("'", APOSTROPHE), (" ", BLANK), ("stmd", ONE), ("r", R), ("v", V), ("l", L), ("e", E)):
        for c in chars:
            table[ord(c)] = kind
    return table


def boundaries(classes: np.ndarray) -> np.ndarray:
    """True where a slice begins.  ``classes`` has a BREAK after every text."""
    state, kind = states_before(classes), KIND[classes]
    after = np.concatenate((kind[1:], np.array([4], np.uint8)))
    before = np.concatenate((np.array([4], np.uint8), kind[:-1]))
    blank = state == AFTER_BLANK
    # white space begins a slice after anything else, and where a run's last one stands before text
    cut = (kind == 3) & ((before != 3) | (after < 3))
    # text begins a slice unless it goes on with its kind or follows a blank
    cut |= (kind < 3) & (before != kind) & ~blank
    now = np.concatenate((state[1:], np.array([START], np.uint8)))  # state after each code point
    one, two = np.flatnonzero(now == DONE1), np.flatnonzero(now == DONE2)
    cut[one] = False
    cut[two - 1] = False
    cut[two] = False
    ended = np.concatenate((one, two)) + 1
    ended = ended[ended < len(cut)]
    cut[ended] = kind[ended] != 4
    # a blank or white space after a contraction was cut already; text after one begins a slice
    cut[kind == 4] = True
    return cut


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file: bytes in base64 and the rank, line by line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As ``merge``, by scanning all pairs: quicker than a heap for a few bytes."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [ranks.get(piece[i : i + 2], NEVER) for i in range(len(piece) - 1)]
    while pairs and (least := min(pairs)) != NEVER:
        at = pairs.index(least)
        parts[at] += parts.pop(at + 1)
        pairs.pop(at)
        if at < len(pairs):
            pairs[at] = ranks.get(parts[at] + parts[at + 1], NEVER)
        if at:
            pairs[at - 1] = ranks.get(parts[at - 1] + parts[at], NEVER)
    return [ranks[x] for x in parts]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a slice: the pair of lowest rank is merged first, the leftmost of equal ones."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n <= SHORT:
        return _merge_short(piece, ranks)
    end = list(range(1, n + 1))  # end of the part that begins here
    before = list(range(-1, n - 1))  # where the part before it begins
    alive = bytearray(b"\x01") * n
    heap = []

    def offer(at: int) -> None:
        middle = end[at]
        if middle < n and (rank := ranks.get(piece[at : end[middle]])) is not None:
            heapq.heappush(heap, (rank, at, middle, end[middle]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, at, middle, to = heapq.heappop(heap)
        if not alive[at] or end[at] != middle or not alive[middle] or end[middle] != to:
            continue
        alive[middle] = 0
        end[at] = to
        if to < n:
            before[to] = at
        offer(at)
        if before[at] >= 0:
            offer(before[at])
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : end[at]]])
        at = end[at]
    return ids


class _Pieces(dict):
    """Ids of slices as little-endian bytes; filled on demand, emptied when full."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) >= CACHE_SLICES:
            self.clear()
        ids = np.array(merge(piece, self.ranks), np.int32).tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


@lru_cache(2)
def _pieces(path: str) -> _Pieces:
    return _Pieces(load_ranks(path))


@lru_cache(1)
def _classes() -> np.ndarray:
    return class_table()


@lru_cache(2)
def _vocabulary(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes joined, and each id's start and length there."""
    ranks = load_ranks(path)
    length = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        length[i] = len(token)
    start = np.concatenate(([0], np.cumsum(length)[:-1]))
    flat = np.zeros(int(length.sum()), np.uint8)
    for token, i in ranks.items():
        flat[start[i] : start[i] + len(token)] = np.frombuffer(token, np.uint8)
    return flat, start, length


def cut_slices(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte borders of the slices of all texts (the last is the end), and slices per text."""
    points, rows = codepoints(data), len(offsets) - 1
    size = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    at = np.concatenate(([0], np.cumsum(size)))  # byte where each code point begins
    ends = np.searchsorted(at, offsets[1:])  # code points before the end of each text
    classes = np.insert(table[points], ends, BREAK)
    breaks = ends + np.arange(rows)
    cut = boundaries(classes)
    cut[breaks] = False
    plain = np.delete(cut, breaks)
    borders = at[:-1][plain]
    per_text = np.searchsorted(borders, offsets[1:]) - np.searchsorted(borders, offsets[:-1])
    return np.append(borders, offsets[-1]), per_text


def encode(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Adds ``ids`` (array of int) and ``starts`` (first byte of each token) to every row.

    The texts are split as the vocabulary's public pattern splits them and every slice is merged
    on its own, without special tokens.  Null and empty texts have no ids; every other column is
    kept, also one named like a column made here (which is replaced).  A row is encoded where it
    lies: no exchange, memory bounded by ``SLICE_BYTES`` or the longest text.

    ``vocabulary`` is a file of ranks that every executor can read at the same path.
    """
    df, back = aside(docs, [text], [c for c in docs.columns if c not in ("ids", "starts")])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, table, (_, _, length) = _pieces(vocabulary), _classes(), _vocabulary(vocabulary)
        for batch in batches:
            for rows, offsets, data in slices(batch, text):
                borders, per_text = cut_slices(data, offsets, table)
                raw = data.tobytes()
                edges = borders.tolist()
                got = [pieces[raw[a:b]] for a, b in zip(edges, itertools.islice(edges, 1, None))]
                counts = np.fromiter(map(len, got), np.int64, len(got)) // 4
                ids = np.frombuffer(b"".join(got), np.int32)
                of_slice = np.concatenate(([0], np.cumsum(counts)))
                of_text = of_slice[np.concatenate(([0], np.cumsum(per_text)))]
                ends = np.cumsum(length[ids]) if len(ids) else np.zeros(0, np.int64)
                starts = ends - length[ids] - np.repeat(offsets[:-1], np.diff(of_text))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, list_array(ids, of_text, pa.int32()), list_array(starts.astype(np.int32), of_text, pa.int32())],
                    names=[*rows.schema.names, "ids", "starts"],
                )

    return in_small_batches(df).mapInArrow(run, f"{fields}, ids array<int>, starts array<int>").select(*back, "ids", "starts")


def decode(rows: DataFrame, vocabulary: str, ids: str = "ids", starts: str = "starts") -> DataFrame:
    """Adds ``decoded`` (binary): every token's bytes put at its retained offset.

    Null ids give null; no ids give empty bytes.  Other columns are kept.
    """
    df, back = aside(rows, [ids, starts], [c for c in rows.columns if c != "decoded"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, start, length = _vocabulary(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                out = []
                for got, to in zip(part.column(part.schema.get_field_index(ids)), part.column(part.schema.get_field_index(starts))):
                    if not got.is_valid:
                        out.append(None)
                        continue
                    i = got.values.to_numpy().astype(np.int64)
                    place = to.values.to_numpy().astype(np.int64)
                    size = length[i]
                    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                    text = np.empty(len(within), np.uint8)
                    text[np.repeat(place, size) + within] = flat[np.repeat(start[i], size) + within]
                    out.append(text.tobytes())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=[*part.schema.names, "decoded"])

    return in_small_batches(df).mapInArrow(run, f"{fields}, decoded binary").select(*back, "decoded")
