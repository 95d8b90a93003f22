"""Secret scans: fixed patterns, and a randomness test battery for strings no pattern names.

Every long unbroken string gets an inferred encoding (digits, hex, base32, letters and digits,
base64) and three tests of the hypothesis that its symbols are drawn evenly and independently from
that alphabet: chi-squared of the symbol counts, the number of runs above and below the alphabet's
middle, and the serial correlation of neighbours.  Their p-values are combined by Fisher's method;
a random secret keeps a high combined value, a word or name does not.

What counts as high depends on the length and the alphabet: short strings of words, and words in a
small alphabet, pass the tests more easily.  So the false-discovery rate is controlled by alphabet
and length band.  The letters of all texts, run together and cut into strings of the bands' lengths,
are tested in each alphabet that has all letters (in one case for those of one case); for hex and
digits, the hex digits and digits of the texts are.  Patterns and tested strings are left out of
these, but for those of letters in one case or capitalised: most are words, and a text may have few
others.  They tell how often a string that is no secret
passes a threshold; the lowest threshold is taken at which the expected share of such strings among
those that pass is at most ``rate``.  Only these histograms (a fixed number of cells) reach the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabledoc.llm.arrow_text import in_small_batches, slices
from tabledoc.session import materialise

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # greedy, so a match is a whole run as in AKIA[A-Z0-9]+
_HEX = re.compile(r"[0-9a-f]{24,}")
_LONG = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: First lengths of the bands.
BANDS = np.array([20, 24, 28, 32, 40, 48, 64, 96, 1 << 40])
#: Cells of the histogram of the combined p-value, by its logarithm.
CELLS, LOWEST = 64, -16.0

_HEX_LOW, _HEX_UP, _B32 = "0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
ALPHABETS = ("0123456789", _HEX_LOW, _HEX_UP, _LETTERS, _LETTERS.upper(), _B32, _B64, _B64 + "+/", _B64 + "-_", _B64 + "+/-_")


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Place of each byte in each alphabet, and the alphabets a byte belongs to as bits."""
    place = np.zeros((len(ALPHABETS), 256), np.int64)
    member = np.zeros(256, np.int64)
    for i, alphabet in enumerate(ALPHABETS):
        for j, c in enumerate(alphabet):
            place[i, ord(c)] = j
            member[ord(c)] |= 1 << i
    return place, member


_PLACE, _MEMBER = _tables()
_SIZE = np.array([len(a) for a in ALPHABETS])
#: The null of each alphabet; alphabets of one size whose symbols stand in one order share theirs.
NULL_OF = np.array([0, 1, 1, 2, 2, 3, 4, 5, 5, 6])
NULLS = int(NULL_OF.max()) + 1


def _codes(*alphabets: str) -> tuple[bytes, bytes]:
    """Arguments of ``bytes.translate`` that turn symbols into their places and drop what is in no alphabet."""
    place, other = bytearray(256), set(range(256))
    for alphabet in alphabets:
        for j, c in enumerate(alphabet):
            place[ord(c)] = j
            other.discard(ord(c))
    return bytes(place), bytes(sorted(other))


_IN_DIGITS, _IN_HEX, _IN_LETTERS = _codes(ALPHABETS[0]), _codes(_HEX_LOW, _HEX_UP), _codes(_LETTERS.upper() + _LETTERS)


def _normal_tail(z: np.ndarray) -> np.ndarray:
    """P(Z > z), to about 1e-7 (Abramowitz and Stegun 26.2.17)."""
    a = np.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = np.exp(-a * a / 2) / np.sqrt(2 * np.pi) * poly
    return np.where(z >= 0, tail, 1 - tail)


def battery(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each ASCII string: log10 of the combined p-value, and the number of its alphabet."""
    raw = [s.rstrip("=").encode("ascii") for s in strings]
    return _tests(np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw], np.int64))


def _tests(data: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``battery``, for strings of lengths ``n`` that follow each other in ``data``."""
    if not len(n):
        return np.zeros(0), np.zeros(0, np.int64)
    ends = np.cumsum(n)
    of = np.repeat(np.arange(len(n)), n)
    common = np.bitwise_and.reduceat(_MEMBER[data], ends - n)
    kind = np.argmax((common[:, None] >> np.arange(len(ALPHABETS))) & 1, axis=1)  # the smallest that holds all
    k = _SIZE[kind].astype(float)
    code = _PLACE[kind[of], data]
    counts = np.bincount(of * 68 + code, minlength=68 * len(n)).reshape(-1, 68)
    inner = np.ones(len(data), bool)
    inner[ends - 1] = False
    at = np.flatnonzero(inner)
    upper = code >= _SIZE[kind[of]] / 2
    changes = np.bincount(of[at], upper[at] != upper[at + 1], minlength=len(n))
    x = (code - (k[of] - 1) / 2) / np.sqrt((k[of] ** 2 - 1) / 12)
    serial = np.bincount(of[at], x[at] * x[at + 1], minlength=len(n))
    return _combined(n, k, (counts.astype(float) ** 2).sum(1), changes, serial), kind


def _combined(n: np.ndarray, k: np.ndarray | int, squares: np.ndarray, changes: np.ndarray, serial: np.ndarray) -> np.ndarray:
    """log10 of the combined p-value of strings of lengths ``n`` over ``k`` symbols.

    ``squares`` has the sums of squared symbol counts, ``changes`` the changes between the alphabet's
    halves, ``serial`` the sums of products of neighbours' places (of mean 0 and variance 1).
    """
    # evenness: chi-squared of symbol counts, by the Wilson-Hilferty normal approximation
    chi = squares * k / n - n
    f = k - 1
    z = ((np.maximum(chi, 1e-9) / f) ** (1 / 3) - (1 - 2 / (9 * f))) / np.sqrt(2 / (9 * f))
    p_even = _normal_tail(z)
    # runs: changes between the alphabet's halves against their expected number, two-sided
    pairs = np.maximum(n - 1, 1)
    p_runs = 2 * _normal_tail(np.abs(changes - pairs / 2) / np.sqrt(pairs / 4))
    # serial correlation of neighbours, two-sided
    p_serial = 2 * _normal_tail(np.abs(serial / np.sqrt(pairs)))
    # Fisher: -2 sum of logs is chi-squared with 6 degrees of freedom
    half = -sum(np.log(np.clip(p, 1e-300, 1)) for p in (p_even, p_runs, p_serial))
    return (-half + np.log1p(half + half * half / 2)) / np.log(10)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and not overlapping for each kind."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    found.sort()
    return found


def _cell(log_p: np.ndarray) -> np.ndarray:
    return np.clip(((log_p - LOWEST) / -LOWEST * CELLS).astype(np.int64), 0, CELLS - 1)


def _outside(doc: str, spans: list[tuple[int, int]]) -> bytes:
    """The text without spans that may overlap."""
    kept, at = [], 0
    for start, end in sorted(spans):
        kept.append(doc[at:start])
        at = max(at, end)
    return "".join([*kept, doc[at:]]).encode()


def _cut(raws: list[bytes], symbols: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the symbols of texts, run together and cut into the bands' lengths in turn; and the bands."""
    lengths, total = BANDS[:-1], int(BANDS[:-1].sum())
    data, band = [b""], [np.zeros(0, np.int64)]
    for raw in raws:
        codes = raw.translate(*symbols)
        turns, rest = divmod(len(codes), total)
        more = int(np.searchsorted(np.cumsum(lengths), rest, "right"))
        band.append(np.concatenate((np.tile(np.arange(len(lengths)), turns), np.arange(more))))
        data.append(codes[: turns * total + int(lengths[:more].sum())])
    return np.frombuffer(b"".join(data), np.uint8).astype(np.int32), np.concatenate(band)


def text_cells(raws: list[bytes]) -> np.ndarray:
    """Counts by null, band and cell of the symbols of texts, run together and cut into the bands' lengths in turn."""
    bands = len(BANDS) - 1
    out = np.zeros((NULLS, bands * CELLS), np.int64)
    digits, hexes, letters = (_cut(raws, x) for x in (_IN_DIGITS, _IN_HEX, _IN_LETTERS))
    one_case = (letters[0] - 26 * (letters[0] >= 26), letters[1])
    for (code, band), kinds in ((digits, (0,)), (hexes, (1,)), (one_case, (3, 5)), (letters, (6, 7, 9))):
        if not len(band):
            continue
        n = BANDS[band]
        starts = np.cumsum(n) - n
        last = starts + n - 1
        counts = np.bincount(np.repeat(np.arange(len(n)) * 68, n) + code, minlength=68 * len(n)).reshape(-1, 68)
        squares = (counts.astype(float) ** 2).sum(1)
        products, sums = (np.append(f(code[:-1], code[1:]), 0) for f in (np.multiply, np.add))
        products[last] = sums[last] = 0
        products, sums = np.add.reduceat(products, starts), np.add.reduceat(sums, starts)
        for kind in kinds:
            k = int(_SIZE[kind])
            upper = code >= k / 2
            changed = np.append(upper[:-1] != upper[1:], False)
            changed[last] = False
            mean = (k - 1) / 2
            serial = (products - mean * sums + (n - 1) * mean * mean) / ((k * k - 1) / 12)
            log_p = _combined(n, k, squares, np.add.reduceat(changed, starts, dtype=np.int64), serial)
            out[NULL_OF[kind]] += np.bincount(band * CELLS + _cell(log_p), minlength=bands * CELLS)
    return out.reshape(-1)


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds spans of fixed patterns and tested strings of the text to every row.

    ``_base`` and ``_tested`` are arrays of structs; ``_tested`` has the cell of the combined p-value,
    the alphabet, the length band, and whether the string is free of base spans.  ``_cells`` has the
    ``text_cells`` of the texts of a run of rows without spans and tested strings other than words, those
    that are not 0 with their places, at its first row.
    """
    df = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("_base", "_tested", "_cells")])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
    test = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("band", pa.int32()), ("cell", pa.int32()), ("free", pa.bool_())])
    some = pa.struct([("at", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, offsets, data in slices(batch, text):
                raw, at = data.tobytes(), offsets.tolist()
                base, n_base, where, strings, n_tested, rest = [], [], [], [], [], []
                for a, b in zip(at, at[1:]):
                    doc = raw[a:b].decode("utf-8")
                    found = base_spans(doc)
                    base += found
                    n_base.append(len(found))
                    before = len(strings)
                    for m in _LONG.finditer(doc):
                        s, e = m.span()
                        where.append((s, e, not any(s < y and x < e for x, _, y in found)))
                        strings.append(m[0])
                    n_tested.append(len(strings) - before)
                    rest.append(_outside(doc, [(x, y) for x, _, y in found] + [w[:2] for w, t in zip(where[before:], strings[before:]) if not _WORD.fullmatch(t)]))
                log_p, kind = battery(strings)
                band = np.searchsorted(BANDS, [e - s for s, e, _ in where], "right") - 1
                cell = _cell(log_p)
                tested = [(s, e, int(k), int(i), int(c), f) for (s, e, f), k, i, c in zip(where, kind, band, cell)]
                cells = text_cells(rest)
                full = np.flatnonzero(cells)
                yield pa.RecordBatch.from_arrays(
                    [
                        *rows.columns,
                        _structs(base, ("start", "kind", "end"), n_base, span),
                        _structs(tested, ("start", "end", "kind", "band", "cell", "free"), n_tested, test),
                        _structs(list(zip(full.tolist(), cells[full].tolist())), ("at", "n"), [len(full)] * (len(at) > 1) + [0] * (len(at) - 2), some),
                    ],
                    names=[*rows.schema.names, "_base", "_tested", "_cells"],
                )

    return in_small_batches(df).mapInArrow(
        run,
        f"{fields}, _base array<struct<start: long, kind: int, end: long>>,"
        " _tested array<struct<start: long, end: long, kind: int, band: int, cell: int, free: boolean>>, _cells array<struct<at: int, n: long>>",
    )


def _structs(values: list[tuple], names: tuple[str, ...], counts: list[int], kind: pa.StructType) -> pa.ListArray:
    columns = list(zip(*values)) if values else [[]] * len(names)
    flat = pa.StructArray.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, kind)], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), flat)


def thresholds(found: DataFrame, rate: float = 0.01) -> list[int]:
    """The lowest cell of each alphabet and band whose estimated false-discovery rate is at most ``rate``.

    ``CELLS`` where there is none.
    """
    bands = len(BANDS) - 1
    null, seen = np.zeros(NULLS * bands * CELLS), np.zeros((len(ALPHABETS), bands, CELLS))
    for at, n in found.select(F.explode("_cells").alias("c")).groupBy("c.at").agg(F.sum("c.n")).collect():  # nulls x bands x cells rows
        null[at] = n
    null = null.reshape(NULLS, bands, CELLS)
    tested = found.select(F.explode("_tested").alias("t")).groupBy("t.kind", "t.band", "t.cell").count()
    for kind, band, cell, n in tested.collect():  # at most alphabets x bands x cells
        seen[kind, band, cell] = n
    out = []
    for kind in range(len(ALPHABETS)):
        for band in range(bands):
            own, words = seen[kind, band], null[NULL_OF[kind], band]
            passing = np.cumsum(own[::-1])[::-1]
            false = (1 + np.cumsum(words[::-1])[::-1]) / (1 + words.sum()) * own.sum()
            good = np.flatnonzero((passing > 0) & (false <= rate * passing))
            out.append(int(good[0]) if len(good) else CELLS)
    return out


def scan(docs: DataFrame, text: str = "text", rate: float = 0.01, keep: list[str] | None = None) -> DataFrame:
    """Adds ``spans`` to every row: structs (start, kind, end) in code points, end exclusive.

    Kinds are numbers in ``KINDS``.  Spans are ordered by start, then kind; those of the battery do not
    overlap a pattern's.  Null and empty texts have none; repeated rows are scanned each on its own;
    an empty table gives no rows.  ``keep`` names the columns to keep, all but the text by default; a
    column called ``spans`` is replaced.  The texts are read once; what was found is written to the
    shared folder, as the thresholds need all of it first.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != "spans" and (keep is not None or c != text)]
    # the columns go through under names that no column made here has
    inner = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    kept = [F.col(inner[c]).alias(c) for c in keep]
    renamed = docs.select(*[F.col(f"`{c}`").alias(inner[c]) for c in docs.columns if c in keep or c == text])
    found = candidates(renamed, inner[text]).select(*[inner[c] for c in keep], "_base", "_tested", "_cells")
    found = materialise(found, "secrets")
    least = F.array(*[F.lit(x) for x in thresholds(found, rate)])
    good = F.filter("_tested", lambda t: t["free"] & (t["cell"] >= F.get(least, t["kind"] * (len(BANDS) - 1) + t["band"])))
    added = F.transform(good, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    return found.select(*kept, F.array_sort(F.concat("_base", added)).alias("spans"))


@F.arrow_udf(T.StringType())  # a type object, as a name would need a session at import
def _hidden(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, cuts in zip(texts.to_pylist(), spans.to_pylist()):
        parts, at = [], 0
        for s in cuts:
            if s["start"] >= at:
                parts += [text[at : s["start"]], "<secret>"]
            at = max(at, s["end"])
        out.append("".join(parts) + text[at:])
    return pa.array(out, pa.string())


def redact(docs: DataFrame, text: str = "text", rate: float = 0.01) -> DataFrame:
    """The rows with ``<secret>`` in place of every span that ``scan`` finds; overlapping spans are one.

    Null texts stay null.  No row goes and no other column changes, whatever its name.
    """
    inner = {c: f"_doc_{i}" for i, c in enumerate(docs.columns)}
    found = scan(docs.select(*[F.col(f"`{c}`").alias(inner[c]) for c in docs.columns]), inner[text], rate, list(inner.values()))
    some, whole = F.size("spans") > 0, F.col(inner[text])
    cut = _hidden(F.when(some, whole).otherwise(""), F.when(some, F.col("spans")).otherwise(F.expr("slice(spans, 1, 0)")))
    return found.select(*[(F.when(some, cut).otherwise(whole) if c == text else F.col(inner[c])).alias(c) for c in docs.columns])
