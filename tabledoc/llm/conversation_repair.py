"""Repair of conversations by grammar-compressed dynamic programming.

A conversation is a string of symbols, one for each row: its role and its fault.  Re-Pair replaces the pairs
of symbols that are most frequent in the whole corpus by new symbols, round by round, so that a few rules stand for
most of all conversations.  Each symbol has one matrix over the states of the wanted pattern of roles: the cheapest edits
that lead from one state to another, as cost and audit.  Matrices multiply by (min, +); of equal costs the audit that is
least in ASCII counts.  A rule's matrix is the product of its two parts' and its audits are ropes that share
theirs, so that two audits are compared by hashes without being written out.  The matrices are evaluated bottom-up
once; a conversation, cut into chunks of bounded size, is the product of a few of them, and equal chunks share it.

Equal costs on the same rows make no audit the beginning of another (the longer one would insert more and cost
more), so the least audit of a whole is made of least audits of its parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabledoc.llm.arrow_text import char_offsets, codepoints, utf8
from tabledoc.llm.joins import small_side
from tabledoc.operators.ordered import numbered
from tabledoc.session import materialise

#: Rows of a chunk of a conversation.
CHUNK = 4096
#: Rows that order a conversation in one task, about.
BUCKET_ROWS = 1 << 16
#: Rounds of Re-Pair and rules made in each; they bound the grammar, not what it is applied to.
ROUNDS, RULES = 10, 64
#: What two code points of a pair are held in.
_BITS, _FIRST_RULE = 21, 0x100
#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States: nothing said yet, after the system's, the user's, the assistant's turn; the first and last may end a conversation.
STATES, ENDS = 4, (0, 3)
_NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_PRIME = (1 << 61) - 1

# ------------------------------------------------------------------ ropes and matrices
# A rope is (length, hash, left, right), a leaf (length, hash, text, None); a cell is None or (cost, rope).


def leaf(text: str) -> tuple:
    return len(text), int.from_bytes(text.encode(), "big") % _PRIME, text, None


def join(a: tuple, b: tuple) -> tuple:
    if not a[0]:
        return b
    if not b[0]:
        return a
    return a[0] + b[0], (a[1] * pow(256, b[0], _PRIME) + b[1]) % _PRIME, a, b


def before(a: tuple, b: tuple) -> bool:
    """Whether rope ``a`` is less than ``b``; parts of equal length and hash are skipped unread."""
    left, right = [a], [b]
    while left and right:
        x, y = left.pop(), right.pop()
        if x is y or x[:2] == y[:2]:
            continue
        if x[3] is None and y[3] is None:
            n = min(x[0], y[0])
            if x[2][:n] != y[2][:n]:
                return x[2][:n] < y[2][:n]
            left += [leaf(x[2][n:])] if x[0] > n else []
            right += [leaf(y[2][n:])] if y[0] > n else []
        elif y[3] is None or (x[3] is not None and x[0] >= y[0]):
            left += [x[3], x[2]]
            right.append(y)
        else:
            right += [y[3], y[2]]
            left.append(x)
    return bool(right)


def written(rope: tuple) -> str:
    out, left = [], [rope]
    while left:
        x = left.pop()
        if x[3] is None:
            out.append(x[2])
        else:
            left += [x[3], x[2]]
    return "".join(out)


def better(a: tuple | None, b: tuple | None) -> tuple | None:
    """The cheaper cell, of equal costs the one with the lesser audit."""
    if a is None or b is None:
        return b if a is None else a
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return b if before(b[1], a[1]) else a


def times(a: list, b: list) -> list:
    """The (min, +) product of two matrices, or of a row and a matrix."""
    out = []
    for p in range(0, len(a), STATES):
        for q in range(STATES):
            ways = [(a[p + k], b[k * STATES + q]) for k in range(STATES)]
            ways = [(x[0] + y[0], x, y) for x, y in ways if x is not None and y is not None]
            best = None
            if ways:
                least = min(w[0] for w in ways)
                for cost, x, y in ways:
                    if cost == least:
                        best = better(best, (cost, join(x[1], y[1])))
            out.append(best)
    return out


def _inserted() -> list:
    """From state to state by inserted turns only."""
    out = [None] * STATES**2
    for p in range(STATES):
        at, cost, text = p, 0, ""
        out[p * STATES + p] = (0, leaf(""))
        for _ in range(2):
            at, cost, text = (3 if at == 2 else 2), cost + INSERT, text + "I"
            out[p * STATES + at] = better(out[p * STATES + at], (cost, leaf(text)))
    return out


INSERTED = _inserted()


def base_matrices() -> dict[str, list]:
    """Of each symbol: what its row costs, with turns inserted after it.

    ``x`` must be deleted; others are the role's class (system, user, assistant, other), in upper case if truncated.
    """
    out = {}
    for symbol in "xsuaoSUAO":
        cells = [None] * STATES**2
        extra, role = (TRUNCATED if symbol.isupper() else 0), symbol.lower()
        for p in range(STATES):
            cells[p * STATES + p] = (DELETE, leaf("D"))
        if symbol != "x":
            for p in range(STATES):
                to = 3 if p == 2 else 2
                cells[p * STATES + to] = better(cells[p * STATES + to], (REROLE + extra, leaf("R")))
            for p, q in _NEXT.get(role, {}).items():
                cells[p * STATES + q] = better(cells[p * STATES + q], (extra, leaf("K")))
        out[symbol] = times(cells, INSERTED)
    return out


# ------------------------------------------------------------------ Re-Pair


@dataclass(frozen=True)
class Grammar:
    """Rounds of rules: sorted codes of pairs and the symbols that replace them."""

    rounds: tuple[tuple[np.ndarray, np.ndarray], ...] = ()

    def compress(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Replaces pairs inside each string, leftmost first, in the order of the rounds."""
        points = points.astype(np.int64)
        for codes, symbols in self.rounds:
            pairs = _pairs(points, offsets)
            at = np.minimum(np.searchsorted(codes, pairs), len(codes) - 1)
            where = np.flatnonzero(codes[at] == pairs)
            if not len(where):
                continue
            # of pairs that overlap, every other one from the left
            fresh = np.concatenate(([True], np.diff(where) > 1))
            run = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            where = where[(np.arange(len(where)) - run) % 2 == 0]
            points[where] = symbols[at[where]]
            keep = np.ones(len(points), bool)
            keep[where + 1] = False
            offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
            points = points[keep]
        return points, offsets

    def matrices(self) -> dict[int, list]:
        """Of every symbol, evaluated bottom-up: one product for each rule."""
        out = {ord(s): m for s, m in base_matrices().items()}
        for codes, symbols in self.rounds:
            for code, symbol in zip(codes.tolist(), symbols.tolist()):
                out[symbol] = times(out[code >> _BITS], out[code & ((1 << _BITS) - 1)])
        return out


def _pairs(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Codes of adjacent symbols; -1 where a string ends between them."""
    codes = points[:-1] << _BITS | points[1:]
    ends = offsets[(offsets > 0) & (offsets < len(points))]
    codes[ends - 1] = -1
    return codes


def _strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets, data = utf8(column)
    return codepoints(data).astype(np.int64), char_offsets(offsets, data)


def re_pair(strings: DataFrame, rounds: int = ROUNDS, rules: int = RULES) -> Grammar:
    """Rules for the most frequent pairs of ``symbols``, each string counted ``n`` times.

    A round counts all pairs of all strings in Spark and takes up to ``rules`` of those that occur twice or more.
    """
    grammar, symbol = Grammar(), _FIRST_RULE
    for _ in range(rounds):

        def count(batches: Iterator[pa.RecordBatch], known: Grammar = grammar) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                points, offsets = _strings(batch.column(0))
                points, offsets = known.compress(points, offsets)
                if len(points) < 2:
                    continue
                times_of = np.repeat(batch.column(1).to_numpy(), np.diff(offsets))[:-1]
                codes, at = np.unique(_pairs(points, offsets), return_inverse=True)
                n = np.bincount(at, times_of).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(codes[codes >= 0]), pa.array(n[codes >= 0])], names=["pair", "n"])

        found = strings.select("symbols", "n").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        found = found.where(F.col("n") > 1).orderBy(F.desc("n"), "pair").limit(2 * rules).collect()
        taken, first, second = [], set(), set()
        for r in found:
            a, b = r["pair"] >> _BITS, r["pair"] & ((1 << _BITS) - 1)
            if a not in second and b not in first and len(taken) < rules:  # pairs that cannot overlap one another
                taken.append(r["pair"])
                first.add(a)
                second.add(b)
        if not taken:
            break
        codes = np.sort(np.array(taken, np.int64))
        grammar = Grammar((*grammar.rounds, (codes, symbol + np.arange(len(codes)))))
        symbol += len(codes)
    return grammar


# ------------------------------------------------------------------ Spark

_CELLS = "cost array<int>, audit array<string>"


def _evaluate(strings: DataFrame, grammar: Grammar) -> DataFrame:
    """Of each distinct chunk, the cells of its matrix (null cost: impossible)."""
    shared = strings.sparkSession.sparkContext.broadcast((grammar, grammar.matrices()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, matrices = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            points, offsets = grammar.compress(*_strings(batch.column(0)))
            costs, audits = [], []
            for row in np.split(points, offsets[1:-1]):
                product = matrices[int(row[0])]
                for symbol in row[1:].tolist():
                    product = times(product, matrices[symbol])
                costs.append([None if c is None else c[0] for c in product])
                audits.append([None if c is None else written(c[1]) for c in product])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(costs, pa.list_(pa.int32())), pa.array(audits, pa.list_(pa.string()))], names=["symbols", "cost", "audit"]
            )

    return strings.select("symbols").mapInArrow(run, f"symbols string, {_CELLS}")


_TOTALS = "blank duplicate truncated illegal".split()


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of whole conversations, in order, to the edits of each chunk; the first one has the totals."""
    names = ["_c", "chunk", "state", "edits", *_TOTALS, "gaps", "cost", "audit"]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * 6, pa.string()]

    def done(chunks: list[dict]) -> list[tuple]:
        first = best = INSERTED[:STATES]
        backs = []
        for chunk in chunks:
            after, back = [None] * STATES, [None] * STATES
            for p in range(STATES):
                for q in range(STATES):
                    cost = chunk["cost"][p * STATES + q]
                    if best[p] is None or cost is None:
                        continue
                    way = (best[p][0] + cost, join(best[p][1], leaf(chunk["audit"][p * STATES + q])))
                    if better(after[q], way) is way:
                        after[q], back[q] = way, p
            best = after
            backs.append(back)
        cost, rope, state = min(
            ((best[q][0], best[q][1], q) for q in ENDS if best[q] is not None), key=lambda w: (w[0], written(w[1]))
        )
        audit, slices = written(rope), []
        for chunk, back in zip(reversed(chunks), reversed(backs)):
            start = back[state]
            slices.append((start, chunk["audit"][start * STATES + state]))
            state = start
        slices.reverse()
        if first[state][1][0]:  # turns inserted before the first row
            slices[0] = (0, written(first[state][1]) + slices[0][1])
        illegal = sum(
            a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(chunks, chunks[1:])
        )
        low = min((c["low"] for c in chunks if c["low"] is not None), default=None)
        gaps = 0
        if low is not None:
            known = [c for c in chunks if c["low"] is not None]
            distinct = sum(c["turns"] for c in known) - sum(a["high"] == b["low"] for a, b in zip(known, known[1:]))
            gaps = min(max(c["high"] for c in known) - low + 1 - distinct, np.iinfo(np.int64).max)
        totals = [sum(c[t] for c in chunks) for t in _TOTALS]
        totals[3] += illegal
        return [
            (chunk["_c"], chunk["chunk"], state, edits, *((*totals, gaps, cost, audit) if not i else [None] * 7))
            for i, (chunk, (state, edits)) in enumerate(zip(chunks, slices))
        ]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    gathered, out = [], []
    for batch in batches:
        for row in batch.to_pylist():
            if gathered and gathered[-1]["_c"] != row["_c"]:
                out += done(gathered)
                gathered = []
            gathered.append(row)
        if out:
            yield batch_of(out)
            out = []
    if gathered:
        yield batch_of(done(gathered))


_SOLVED = "_c string, chunk long, state int, edits string, blank long, duplicate long, truncated long, illegal long, gaps long, cost long, audit string"


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits followed by the rows of their chunk, conversation by conversation, to the repaired messages."""
    names = ["_c", "position", "edit", "turn", "role", "text"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
    now, position, state, edits, at = None, 0, 0, "", 0
    for batch in batches:
        out = []

        def say(edit: str, turn, role: str, text: str) -> None:
            nonlocal position, state
            out.append((now, position, edit, turn, role, text))
            position += 1
            state = 1 if edit == "K" and role[:1] == "s" else 3 if state == 2 else 2

        def insert() -> None:
            nonlocal at
            while at < len(edits) and edits[at] == "I":
                say("I", None, "assistant" if state == 2 else "user", "")
                at += 1

        for c, new, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if new is not None:
                if c != now:
                    now, position, state = c, 0, 0
                edits, at = new, 0
                insert()
                continue
            edit = edits[at]
            at += 1
            if edit != "D":
                role = role if edit == "K" else "assistant" if state == 2 else "user"
                say(edit, turn, role, text)
            insert()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, held, out = None, None, []
    for batch in batches:
        for c, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if c != now:
                if held:
                    out.append((now, held.hexdigest()))
                now, held = c, hashlib.sha256(f"{role}:{text}".encode())
            else:
                held.update(f"\n{role}:{text}".encode())
        if len(out) > 1000:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out)], names=["_c", "sha256"])
            out = []
    if held:
        out.append((now, held.hexdigest()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out)], names=["_c", "sha256"])


@dataclass(frozen=True)
class Repaired:
    """``messages``: repaired turns (``_c, position, edit, turn, role, text``), each conversation's together and in order.

    ``conversations``: one row for each that has rows (``_c, gaps, blank, duplicate, truncated, illegal, cost, audit``).
    ``_c`` is ``name`` of the conversation's id.
    """

    messages: DataFrame
    conversations: DataFrame


def name(key: Column) -> Column:
    """A conversation's id as a string, its null included."""
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("null"))


def repair(messages: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK) -> Repaired:
    """The cheapest edits that give every conversation roles ``(s?(ua)+)?`` by their initials.

    Rows are taken by turn (nulls first), then role, then text.  A row's first fault counts: blank (no character but ASCII
    white space), duplicate (role and text seen earlier), truncated (last such character is none of ``.!?``).  Keep costs
    nothing, another role (user or assistant) 2, deleting 3 (required for blank and duplicate rows), inserting an empty turn of
    the user or assistant 2; a truncated row that stays adds 1.  ``audit`` has the edits' initials in order, of equal costs
    the least.  ``illegal`` counts neighbours whose initials are not su, ua or au, ``gaps`` the turns missing between
    the least and the greatest.

    Null roles and texts are one space, a null key is a conversation, an empty role has no initial and cannot be kept.  No rows
    give no rows; other columns are ignored.  A conversation may be of any length: it is ordered in buckets, solved
    in chunks, and its texts are read as a stream; only its audit is held whole.  One text of any length is one row.
    """
    rows = messages.select(
        name(F.col(f"`{key}`")).alias("_c"), F.col(f"`{turn}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit(" ")).alias("text"),
    )
    rows = numbered(materialise(rows, "turns"), ["_c"], "turn", out="pos", then=("role", "text"), size=BUCKET_ROWS)
    rows = materialise(rows.withColumn("chunk", F.floor((F.col("pos") - 1) / chunk)), "turns")

    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    marks = rows.select(
        "_c", "pos", "chunk", "turn", F.substring("role", 1, 1).alias("initial"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"),
    )
    # the first of equal rows is the one with the smallest number; numbers are joined, as they are never a hot key
    new = rows.groupBy("_c", "role", F.sha2("text", 256)).agg(F.min("pos").alias("pos")).select("_c", "pos", F.lit(True).alias("new"))
    fault = F.when(F.col("blank"), 1).when(F.col("new").isNull(), 2).when(F.col("cut"), 3).otherwise(0)
    marks = marks.join(new, ["_c", "pos"], "left").withColumn("fault", fault)
    kind = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    symbol = F.when(F.col("fault").isin(1, 2), F.lit("x")).when(F.col("fault") == 3, F.upper(kind)).otherwise(kind)
    row = F.struct("pos", symbol.alias("symbol"), "initial", "turn")
    n = lambda fault: F.sum((F.col("fault") == fault).cast("long"))
    # a chunk has a bounded number of rows
    chunks = marks.groupBy("_c", "chunk").agg(
        F.array_sort(F.collect_list(row)).alias("rows"), n(1).alias("blank"), n(2).alias("duplicate"), n(3).alias("truncated"),
        F.min("turn").alias("low"), F.max("turn").alias("high"),
    )
    said = F.transform("rows", lambda x: x["initial"])
    neighbours = F.zip_with(F.slice(said, 1, F.size(said) - 1), F.slice(said, 2, F.size(said)), lambda a, b: F.concat(a, b))
    chunks = materialise(
        chunks.select(
            "_c", "chunk", F.array_join(F.transform("rows", lambda x: x["symbol"]), "").alias("symbols"), "blank", "duplicate", "truncated", "low", "high",
            F.size(F.array_distinct(F.array_compact(F.transform("rows", lambda x: x["turn"])))).cast("long").alias("turns"),
            F.size(F.filter(neighbours, lambda x: ~x.isin("su", "ua", "au"))).cast("long").alias("illegal"),
            F.get(said, F.lit(0)).alias("first"), F.element_at(said, -1).alias("last"),
        ),
        "chunks",
    )
    strings = materialise(chunks.groupBy("symbols").agg(F.count("*").alias("n")), "strings")
    cells = _evaluate(strings, re_pair(strings))
    # its cells hold sixteen audits about as long as the string
    known = small_side(cells, F.length("symbols") * 32 + 400, 100_000_000)
    solved = chunks.join(known, "symbols").drop("symbols").repartition("_c").sortWithinPartitions("_c", "chunk")
    solved = materialise(solved.mapInArrow(_solve, _SOLVED), "repairs")

    none = lambda kind: F.lit(None).cast(kind)
    stream = solved.select(
        "_c", F.col("edits").alias("new"), none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"), "chunk", F.lit(0).cast("long").alias("pos")
    ).unionByName(rows.select("_c", none("string").alias("new"), "turn", "role", "text", "chunk", "pos"))
    stream = stream.repartition("_c").sortWithinPartitions("_c", "chunk", "pos").drop("chunk", "pos")
    repaired = stream.mapInArrow(_apply, "_c string, position long, edit string, turn long, role string, text string")
    totals = solved.where(F.col("cost").isNotNull()).select("_c", "gaps", *_TOTALS, "cost", "audit")
    return Repaired(repaired, totals)


def digests(messages: DataFrame) -> DataFrame:
    """``_c, sha256`` of every conversation's ``role:text`` lines, of ``Repaired.messages`` as they lie; streamed."""
    return messages.select("_c", "role", "text").mapInArrow(_hash, "_c string, sha256 string")
