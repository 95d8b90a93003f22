"""Conversation repair against plain dynamic programming and against all edits, and its edge cases."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from tabledoc.llm import conversation_repair as repair
from tabledoc.llm.queries import QUERIES, damaged
from tabledoc.session import load_table

SPACE = " \t\n\x0b\x0c\r"


def _faults(rows):
    """'x' for blank and duplicate rows, 't' for truncated ones, '' for others; and their counts."""
    seen, out, n = set(), [], collections.Counter()
    for _, role, text in rows:
        kind = "blank" if not text.strip(SPACE) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(SPACE)[-1] not in ".!?" else ""
        seen.add((role, text))
        n[kind] += 1
        out.append({"blank": "x", "duplicate": "x", "truncated": "t", "": ""}[kind])
    return out, n


def _cheapest(rows, faults):
    """(cost, audit, lines) by plain dynamic programming over rows and states."""
    step = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
    full = {"u": "user", "a": "assistant"}

    def closed(best):
        for p in [0, 1, 3, 2, 3]:
            c = "a" if p == 2 else "u"
            if p in best:
                cost, audit, lines = best[p]
                way = (cost + 2, audit + "I", lines + (full[c] + ":",))
                best[step[c, p]] = min(best.get(step[c, p], way), way, key=lambda w: w[:2])
        return best

    best = closed({0: (0, "", ())})
    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for p, (cost, audit, lines) in best.items():
            ways = [(p, (cost + 3, audit + "D", lines))]
            if fault != "x":
                more = fault == "t"
                if (role[:1], p) in step:
                    ways.append((step[role[:1], p], (cost + more, audit + "K", lines + (f"{role}:{text}",))))
                c = "a" if p == 2 else "u"
                ways.append((step[c, p], (cost + 2 + more, audit + "R", lines + (f"{full[c]}:{text}",))))
            for q, way in ways:
                after[q] = min(after.get(q, way), way, key=lambda w: w[:2])
        best = closed(after)
    return min((best[q] for q in (0, 3) if q in best), key=lambda w: w[:2])


def _want(rows):
    """The result of one conversation of (turn, role, text) rows."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, n = _faults(rows)
    cost, audit, lines = _cheapest(rows, faults)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def _got(messages, chunk=repair.CHUNK):
    out = repair.repair(messages, chunk=chunk)
    sha = {r["_c"]: r["sha256"] for r in repair.digests(out.messages).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return {r["_c"]: (*[r[n] for n in names], sha.get(r["_c"], empty)) for r in out.conversations.collect()}


def _conversations(seed, count, longest):
    rng = random.Random(seed)
    texts = ["Fine.", "Why?", "cut off", "", " \t", "No!", "ends. \n", "été", None, "x:y.", "a", "　"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "ua", "", None, "s"]
    out = {}
    for c in range(count):
        n, plain = rng.randint(1, longest), rng.random() < 0.4
        out[c] = [
            (None if rng.random() < 0.05 else rng.randint(0, 2 * n),
             ("user", "assistant")[i % 2] if plain and rng.random() < 0.9 else rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"line {rng.randint(0, n)}.")
            for i in range(n)
        ]
    return out


def _table(spark, said):
    rows = [(c, *r, "z", 1) for c, rows in said.items() for r in rows]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, _c string, pos int")


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_repairs_equal_plain_dynamic_programming(spark, chunk):
    said = _conversations(3, 150, 9) | {1000 + c: r for c, r in _conversations(4, 3, 300).items()}
    got = _got(_table(spark, said), chunk)
    assert got == {f"={c}": _want(rows) for c, rows in said.items()}


def test_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(repair, "BUCKET_ROWS", 1000)
    rng = random.Random(9)
    rows = [(i, ("user", "assistant")[i % 2] if rng.random() < 0.98 else "system", f"{rng.randint(0, 9000)}{rng.choice('.!?,')}") for i in range(10_000)]
    assert _got(_table(spark, {5: rows, 6: rows[:50]})) == {"=5": _want(rows), "=6": _want(rows[:50])}


def test_plain_programming_equals_all_edits():
    """All audits of short conversations, by cost and then by ASCII."""
    def roles_of(audit, rows, faults):
        out, cost, at, state = "", 0, 0, 0
        for e in audit:
            c = "a" if out and out[-1] == "u" else "u"
            if e == "I":
                out, cost = out + c, cost + 2
                continue
            fault, role = faults[at], rows[at][1][:1]
            at += 1
            if e == "D":
                cost += 3
            elif fault == "x":
                return None
            else:
                out, cost = out + (role if e == "K" else c), cost + (2 if e == "R" else 0) + (fault == "t")
        return cost if at == len(rows) and re.fullmatch("(s?(ua)+)?", out) else None

    rng = random.Random(5)
    for _ in range(60):
        rows = [(i, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", "", "c."])) for i in range(rng.randint(1, 4))]
        faults, _ = _faults(rows)
        every = []
        for kinds in itertools.product("DKR", repeat=len(rows)):
            for holes in itertools.product(range(3), repeat=len(rows) + 1):
                if sum(holes) <= 4:
                    audit = "I" * holes[0] + "".join(k + "I" * h for k, h in zip(kinds, holes[1:]))
                    cost = roles_of(audit, rows, faults)
                    if cost is not None:
                        every.append((cost, audit))
        assert min(every) == _cheapest(rows, faults)[:2]


def test_edge_rows(spark):
    said = {
        1: [(None, None, None)], 2: [(1, "", "Text.")], 3: [(5, "user", "A."), (5, "user", "A.")], 4: [(None, "user", "a."), (None, "assistant", "b.")],
        5: [(-(2**63), "user", "a."), (2**63 - 1, "assistant", "b.")], None: [(0, "user", "no id.")], 6: [(0, "assistant", "w " * 300_000 + ".")],
    }
    want = {("null" if c is None else f"={c}"): _want(rows) for c, rows in said.items()}
    want["=5"] = (2**63 - 1, *want["=5"][1:])
    assert _got(_table(spark, said)) == want
    assert _got(_table(spark, {1: [(0, "user", "a.")]}).limit(0)) == {}


def test_ropes_compare_as_their_texts():
    rng = random.Random(2)
    for _ in range(300):
        def rope(text):
            if len(text) < 2 or rng.random() < 0.3:
                return repair.leaf(text)
            at = rng.randint(0, len(text))
            return repair.join(rope(text[:at]), rope(text[at:]))

        a = "".join(rng.choices("DK", k=rng.randint(0, 12)))
        b = a[: rng.randint(0, 12)] + "".join(rng.choices("DK", k=rng.randint(0, 4)))
        x, y = rope(a), rope(b)
        assert repair.written(x) == a and repair.before(x, y) == (a < b) and repair.before(y, x) == (b < a)


def test_grammar_keeps_the_strings(spark):
    rng = random.Random(6)
    strings = ["".join(rng.choices("uaUx", weights=(5, 5, 1, 1), k=rng.randint(1, 60))) for _ in range(200)] + ["u" * 101, "ua" * 500, "s"]
    counted = collections.Counter(strings)
    grammar = repair.re_pair(spark.createDataFrame(list(counted.items()), "symbols string, n long"), rounds=6, rules=20)
    parts = {int(s): (int(c) >> repair._BITS, int(c) & ((1 << repair._BITS) - 1)) for codes, symbols in grammar.rounds for c, s in zip(codes, symbols)}

    def spelled(symbol):
        return chr(symbol) if symbol not in parts else "".join(map(spelled, parts[symbol]))

    points = np.array([ord(c) for s in strings for c in s])
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in strings])))
    packed, ends = grammar.compress(points, offsets)
    assert ["".join(map(spelled, packed[a:b].tolist())) for a, b in zip(ends, ends[1:])] == strings
    assert len(parts) > 40 and len(packed) < 0.5 * len(points)


def test_query_equals_brute_force(spark, sf_dir):
    """The damage, too, done by a loop over the table."""
    said = load_table(spark, sf_dir, "conversations").collect()
    left = collections.defaultdict(list)
    for r in said:
        harm = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        text = "" if harm == 1 else re.sub("[.!?]", "", r["text"]) if harm == 2 else r["text"]
        left[r["conv_id"]] += [] if harm == 0 else [(r["turn"], "user" if harm == 4 else r["role"], text)] * (2 if harm == 3 else 1)
    got = {r["conv_id"]: tuple(r)[1:] for r in QUERIES["op13_conversation_repair"].build(spark, sf_dir).collect()}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: _want(left[c]) if left[c] else nothing for c in {r["conv_id"] for r in said}}


def test_damage_of_nulls(spark):
    rows = spark.createDataFrame([(None, None, None, None)] + [(i, None, None, None) for i in range(200)], "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: (r["role"], r["text"]) for r in damaged(rows).collect()}
    for i in [None, *range(200)]:
        harm = zlib.crc32(f"{' ' if i is None else i}: ".encode()) % 20
        want = None if harm == 0 else ("user" if harm == 4 else " ", "" if harm == 1 else " ")
        assert got.get(i) == want
