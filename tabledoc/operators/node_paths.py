"""Path expressions answered on the arrays of a document tree.

A step of a path is a filter over ``nodes``: children come from ``kids``, descendants from the slice between a
node and its ``last``, siblings from the parent's ``kids``, and tests read ``tag``, ``attrs``, ``pos`` and ``tokens``.  The
whole path becomes one SQL expression over a page's row, so a page is neither written as XML nor parsed again.

Covered: child, descendant (``//``), parent and sibling steps, unions, ``(path)[k]``, and tests of attributes, own and whole
text, child elements, places among siblings, ``contains``, ``starts-with``, ``concat``, ``normalize-space``, ``substring``,
``string-length``, ``not``, ``and``, ``or``.  ``compile_path`` gives None for what is not covered.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

_TOKEN = re.compile(
    r"""\s*(?:(?P<text>"[^"]*"|'[^']*')|(?P<number>\d+)(?![\w.])|(?P<name>[A-Za-z_][\w-]*(?:\.[\w-]+)*)"""
    r"""|(?P<mark>//|/|::|\.\.|!=|[.@*()\[\],|=+-]))"""
)
_SPACE = r"[ \\t\\r\\n]+"


class _Uncovered(Exception):
    """The path needs something that is not answered here."""


def _literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _whole_text(node: str, names) -> str:
    t = next(names)
    own = f"slice(tokens, {node}.t0 + 1, {node}.t1 - {node}.t0 + 1)"
    return f"array_join(transform(filter({own}, {t} -> {t}.kind = 1), {t} -> {t}.text), '')"


def _texts(node: str | None, names, own: bool, empty: bool = False) -> str:
    """The texts below a node (None: the document), or its own ones only; text tokens side by side are one text.

    Everything else becomes a NUL, which no text has, and each text begins with a mark that is taken off again.
    """
    t, i, x = next(names), next(names), next(names)
    part = "tokens" if node is None else f"slice(tokens, {node}.t0 + 1, {node}.t1 - {node}.t0 + 1)"
    before = f"get(tokens, {i} - 1).kind" if node is None else f"get(tokens, {node}.t0 + {i} - 1).kind"
    other = f"{t}.kind <> 1" + (f" OR {t}.nid <> {node}.nid" if own else "")
    written = f"CASE WHEN {other} THEN '\\0' WHEN {before} = 1 THEN {t}.text ELSE concat('#', {t}.text) END"
    pieces = f"split(array_join(transform({part}, ({t}, {i}) -> {written}), ''), r'\x00+')"
    return f"transform(filter({pieces}, {x} -> length({x}) > {0 if empty else 1}), {x} -> substring({x}, 2))"


@dataclass(frozen=True)
class _Value:
    """Of a test: ``attr`` (a string or null), ``string``, ``number``, ``bool`` or ``strings`` (one for each node)."""

    kind: str
    sql: str

    def as_string(self) -> str:
        if self.kind == "attr":
            return f"coalesce({self.sql}, '')"
        if self.kind == "strings":
            return f"coalesce(get({self.sql}, 0), '')"
        if self.kind == "string":
            return self.sql
        raise _Uncovered

    def as_bool(self) -> str:
        return {
            "attr": f"({self.sql} IS NOT NULL)", "strings": f"(size({self.sql}) > 0)", "string": f"({self.sql} <> '')", "bool": self.sql,
        }.get(self.kind) or _uncovered()

    def as_number(self) -> str:
        return self.sql if self.kind == "number" else _uncovered()


def _uncovered():
    raise _Uncovered


class _Compiler:
    """Reads a path from left to right and writes the SQL of the nodes it selects."""

    def __init__(self, path: str):
        self.tokens, at, path = [], 0, path.rstrip()
        while at < len(path):
            found = _TOKEN.match(path, at)
            if not found:
                raise _Uncovered
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()
        self.at = 0
        self.names = (f"v{i}" for i in itertools.count())

    def peek(self, ahead: int = 0) -> str | None:
        at = self.at + ahead
        return self.tokens[at][1] if at < len(self.tokens) and self.tokens[at][0] != "text" else None

    def take(self, *marks: str) -> str | None:
        """The next token if it is one of ``marks``."""
        if self.peek() in marks and self.peek() is not None:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, mark: str) -> None:
        if not self.take(mark):
            raise _Uncovered

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise _Uncovered

    # -- paths --------------------------------------------------------------
    def union(self) -> tuple[str, str]:
        """(``nodes`` or ``strings``, SQL of an array) of the whole text."""
        parts = [self.path()]
        while self.take("|"):
            parts.append(self.path())
        if self.at < len(self.tokens):
            raise _Uncovered
        if len(parts) == 1:
            return parts[0]
        if any(kind != "nodes" for kind, _ in parts):
            raise _Uncovered  # strings of several paths would need their places
        return "nodes", f"array_sort(array_distinct(concat({', '.join(sql for _, sql in parts)})))"

    def path(self) -> tuple[str, str]:
        if self.take("("):
            parts = [self.path()]
            while self.take("|"):
                parts.append(self.path())
            self.need(")")
            if any(kind != "nodes" for kind, _ in parts):
                raise _Uncovered
            found = parts[0][1] if len(parts) == 1 else f"array_sort(array_distinct(concat({', '.join(sql for _, sql in parts)})))"
            if self.take("["):
                if self.take("last"):
                    self.need("(")
                    self.need(")")
                    found = f"slice({found}, -1, 1)"
                elif self.at < len(self.tokens) and self.tokens[self.at][0] == "number" and int(self.tokens[self.at][1]):
                    found = f"slice({found}, {int(self.tokens[self.at][1])}, 1)"
                    self.at += 1
                else:
                    raise _Uncovered
                self.need("]")
            return self.steps(found) if self.peek() in ("/", "//") else ("nodes", found)
        return self.steps(None)

    def steps(self, found: str | None) -> tuple[str, str]:
        """Steps from the document (None) or from found nodes."""
        first = found is None
        while True:
            joint = self.take("/", "//")
            if not joint:
                if not first:
                    return "nodes", found
                joint = "/"
            first = False
            end = self.strings(found, joint == "//")
            if end:
                return "strings", end
            found = self.step(found, joint == "//")

    def outermost(self, found: str) -> str:
        """Of nodes in document order, those inside no other."""
        a, c = next(self.names), next(self.names)
        return (
            f"aggregate({found}, named_struct('past', -1, 'kept', CAST(array() AS array<int>)), ({a}, {c}) -> CASE WHEN {c} <= {a}.past THEN {a} "
            f"ELSE named_struct('past', nodes[{c}].last, 'kept', concat({a}.kept, array({c}))) END).kept"
        )

    def strings(self, found: str | None, deep: bool) -> str | None:
        """A last step that yields strings: attributes or texts."""
        c, t = next(self.names), next(self.names)
        if self.peek() == "@":
            self.at += 1
            every = self.take("*")
            name = None if every else self.name()
            if self.at < len(self.tokens) and self.peek() not in ("|", ")"):
                raise _Uncovered
            if found is None and not deep:
                raise _Uncovered  # the document has no attributes
            if deep:
                found = self.within(found, lambda n: "true", own=True)
            if every:
                return f"flatten(transform({found}, {c} -> map_values(nodes[{c}].attrs)))"
            value = f"element_at(nodes[{c}].attrs, {_literal(name)})"
            return f"array_compact(transform({found}, {c} -> {value}))"
        if self.peek() == "text" and self.peek(1) == "(":
            self.at += 2
            self.need(")")
            if self.at < len(self.tokens) and self.peek() not in ("|", ")"):
                raise _Uncovered
            if found is None and not deep:
                return "CAST(array() AS array<string>)"
            if found is None or deep:
                one = _texts(None if found is None else f"nodes[{c}]", self.names, False)
                return one if found is None else f"flatten(transform({self.outermost(found)}, {c} -> {one}))"
            # the texts of nested nodes lie between one another: the places of their first tokens order them
            i = next(self.names)
            own = f"slice(tokens, nodes[{c}].t0 + 1, nodes[{c}].t1 - nodes[{c}].t0 + 1)"
            starts = f"{t}.kind = 1 AND {t}.nid = {c} AND get(tokens, nodes[{c}].t0 + {i} - 1).kind <> 1"
            places = f"array_compact(transform({own}, ({t}, {i}) -> CASE WHEN {starts} THEN nodes[{c}].t0 + {i} END))"
            each = f"zip_with({places}, {_texts(f'nodes[{c}]', self.names, True, empty=True)}, ({t}, {i}) -> named_struct('at', {t}, 'text', {i}))"
            return f"filter(transform(array_sort(flatten(transform({found}, {c} -> {each}))), {t} -> {t}.text), {t} -> {t} <> '')"
        return None

    def within(self, found: str | None, test, own: bool = False) -> str:
        """Descendants (and the nodes themselves) that pass a test, in document order."""
        c, n = next(self.names), next(self.names)
        part = "nodes" if found is None else f"slice(nodes, {c} + {1 if own else 2}, nodes[{c}].last - {c} + {1 if own else 0})"
        passed = f"transform(filter({part}, {n} -> {test(n)}), {n} -> {n}.nid)"
        return passed if found is None else f"flatten(transform({self.outermost(found)}, {c} -> {passed}))"

    def step(self, found: str | None, deep: bool) -> str:
        if self.take(".."):
            axis, tag = "parent", "*"
        elif self.take("."):
            axis, tag = "self", "*"
        elif self.take("*"):
            axis, tag = "child", "*"
        else:
            axis, tag = "child", self.name()
            if self.take("::"):
                axis = tag
                tag = "*" if self.take("*") else self.name()
            if self.peek() == "(":
                raise _Uncovered  # a function or a node type
        start, self.among = self.at, tag if axis == "child" else None
        only_next = axis in ("following-sibling", "preceding-sibling") and tag == "*" and self.peek() == "[" and self.peek(1) == "1" and self.peek(2) == "]"
        if only_next:
            self.at += 3
            start = self.at

        def test(n: str) -> str:
            """Read anew for each place that tests a node, as the node's name differs."""
            self.at = start
            tests = [] if tag == "*" else [f"{n}.tag = {_literal(tag)}"]
            place = self.among is not None
            while self.take("["):
                tests.append(self.test_of(n, tag if place else None))
                self.need("]")
                place = False
            return " AND ".join(tests) or "true"

        c, k = next(self.names), next(self.names)
        if deep and axis == "child":
            return self.within(found, test)
        if deep:
            found = self.within(found, lambda n: "true", own=True)
        if found is None:
            if axis != "child":
                raise _Uncovered
            return f"filter(array(0), {k} -> {test(f'nodes[{k}]')})"
        if axis == "self":
            return f"filter({found}, {k} -> {test(f'nodes[{k}]')})"
        if axis == "descendant":
            return self.within(found, test)
        if axis == "parent":
            return f"array_sort(array_distinct(filter(transform({found}, {c} -> nodes[{c}].parent), {k} -> {k} >= 0 AND {test(f'nodes[{k}]')})))"
        if axis == "child":
            return f"array_sort(flatten(transform({found}, {c} -> filter(nodes[{c}].kids, {k} -> {test(f'nodes[{k}]')}))))"
        kids, idx = f"coalesce(get(nodes, nodes[{c}].parent).kids, CAST(array() AS array<int>))", f"nodes[{c}].idx"
        if axis == "following-sibling":
            part = f"slice({kids}, {idx} + 2, {1 if only_next else f'size({kids})'})"
        elif axis == "preceding-sibling":
            part = f"slice({kids}, greatest({idx}, 1), least({idx}, 1))" if only_next else f"slice({kids}, 1, {idx})"
        else:
            raise _Uncovered
        return f"array_sort(array_distinct(flatten(transform({found}, {c} -> filter({part}, {k} -> {test(f'nodes[{k}]')})))))"

    # -- tests --------------------------------------------------------------
    def test_of(self, n: str, among: str | None) -> str:
        """One test in brackets; a place counts among siblings of ``among``, where it comes first."""
        at, place = self.at, None
        if at >= len(self.tokens):
            raise _Uncovered
        if self.tokens[at][0] == "number":
            place = self.tokens[at][1]
            self.at += 1
        elif self.peek() == "last" and self.peek(1) == "(":
            self.at += 2
            self.need(")")
            place = "last"
        elif self.peek() == "position":
            self.at += 1
            for mark in ("(", ")", "="):
                self.need(mark)
            place = self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] == "number" else _uncovered()
            self.at += 1
        if place is not None:
            if among is None or self.peek() != "]":
                raise _Uncovered
            here, count = (f"{n}.idx + 1", f"coalesce(size(get(nodes, {n}.parent).kids), 1)") if among == "*" else (f"{n}.pos", f"{n}.total")
            if among == "*":
                here = f"CASE WHEN {n}.parent < 0 THEN 1 ELSE {here} END"
            return f"{here} = {count if place == 'last' else int(place)}"
        return self.either(n)

    def either(self, n: str) -> str:
        parts = [self.both(n)]
        while self.take("or"):
            parts.append(self.both(n))
        return parts[0] if len(parts) == 1 else f"({' OR '.join(parts)})"

    def both(self, n: str) -> str:
        parts = [self.compared(n)]
        while self.take("and"):
            parts.append(self.compared(n))
        return parts[0] if len(parts) == 1 else f"({' AND '.join(parts)})"

    def compared(self, n: str) -> str:
        left = self.sum(n)
        op = self.take("=", "!=")
        if not op:
            return left.as_bool()
        right, sql = self.sum(n), "=" if op == "=" else "<>"
        if left.kind == "strings" and right.kind == "string":
            x = next(self.names)
            return f"exists({left.sql}, {x} -> {x} {sql} {right.sql})"
        if {left.kind, right.kind} <= {"attr", "string"}:
            return f"coalesce({left.sql} {sql} {right.sql}, false)"
        return f"({left.as_number()} {sql} {right.as_number()})"

    def sum(self, n: str) -> _Value:
        left = self.operand(n)
        while op := self.take("+", "-"):
            left = _Value("number", f"({left.as_number()} {op} {self.operand(n).as_number()})")
        return left

    def operand(self, n: str) -> _Value:
        if self.at >= len(self.tokens):
            raise _Uncovered
        kind, token = self.tokens[self.at]
        if kind == "text":
            self.at += 1
            return _Value("string", _literal(token[1:-1]))
        if kind == "number":
            self.at += 1
            return _Value("number", str(int(token)))
        if self.take("@"):
            if self.take("*"):
                raise _Uncovered
            name = self.name()
            if name == "__pos":  # the place that a translated selector reads
                return _Value("number", f"{n}.pos")
            return _Value("attr", f"element_at({n}.attrs, {_literal(name)})")
        if self.take("("):
            inner = self.either(n)
            self.need(")")
            return _Value("bool", f"({inner})")
        if self.take("."):
            if self.take("//"):
                return self.inner(n, deep=True)
            if self.peek() == "/":
                raise _Uncovered
            return _Value("string", _whole_text(n, self.names))
        if kind == "name" and self.peek(1) == "(":
            return self.function(n, token)
        if kind == "name" and self.peek(1) == "::":
            return self.axis(n, token)
        return self.inner(n, deep=False)

    def inner(self, n: str, deep: bool) -> _Value:
        """Child or descendant elements of a name as their texts."""
        tag = "*" if self.take("*") else self.name()
        if self.peek() in ("/", "//", "[", "::", "("):
            raise _Uncovered
        k = next(self.names)
        same = "true" if tag == "*" else f"{k}.tag = {_literal(tag)}"
        nodes = f"slice(nodes, {n}.nid + 2, {n}.last - {n}.nid)" if deep else f"transform({n}.kids, {k} -> nodes[{k}])"
        return _Value("strings", f"transform(filter({nodes}, {k} -> {same}), {k} -> {_whole_text(k, self.names)})")

    def axis(self, n: str, axis: str) -> _Value:
        self.at += 2
        tag = "*" if self.take("*") else self.name()
        if self.peek() in ("/", "//", "[", "("):
            raise _Uncovered
        if axis == "self":
            return _Value("bool", "true" if tag == "*" else f"({n}.tag = {_literal(tag)})")
        return _Value("bool", f"({self.siblings(n, axis, tag)} > 0)")

    def siblings(self, n: str, axis: str, tag: str) -> str:
        """SQL: how many siblings of a tag there are before or after."""
        kids = f"coalesce(get(nodes, {n}.parent).kids, CAST(array() AS array<int>))"
        if axis not in ("preceding-sibling", "following-sibling"):
            raise _Uncovered
        if tag == "*":
            before = f"CASE WHEN {n}.parent < 0 THEN 0 ELSE {n}.idx END"
            return before if axis == "preceding-sibling" else f"greatest(size({kids}) - 1 - {n}.idx, 0)"
        k = next(self.names)
        side = f"{k} < {n}.nid" if axis == "preceding-sibling" else f"{k} > {n}.nid"
        return f"size(filter({kids}, {k} -> {side} AND nodes[{k}].tag = {_literal(tag)}))"

    def function(self, n: str, name: str) -> _Value:
        self.at += 2
        if name == "text":
            self.need(")")
            return _Value("strings", _texts(n, self.names, True))
        if name == "not":
            inner = self.either(n)
            self.need(")")
            return _Value("bool", f"(NOT {inner})")
        if name == "count":
            axis = self.name()
            self.need("::")
            tag = "*" if self.take("*") else self.name()
            self.need(")")
            return _Value("number", self.siblings(n, axis, tag))
        if name in ("true", "false"):
            self.need(")")
            return _Value("bool", name)
        args = []
        if not self.take(")"):
            args.append(self.sum(n))
            while self.take(","):
                args.append(self.sum(n))
            self.need(")")
        if name == "normalize-space" and len(args) < 2:
            text = args[0].as_string() if args else _whole_text(n, self.names)
            return _Value("string", f"trim(BOTH ' ' FROM regexp_replace({text}, '{_SPACE}', ' '))")
        if name == "contains" and len(args) == 2:
            return _Value("bool", f"contains({args[0].as_string()}, {args[1].as_string()})")
        if name == "starts-with" and len(args) == 2:
            return _Value("bool", f"startswith({args[0].as_string()}, {args[1].as_string()})")
        if name == "concat" and len(args) > 1:
            return _Value("string", f"concat({', '.join(a.as_string() for a in args)})")
        if name == "string-length" and len(args) == 1:
            return _Value("number", f"length({args[0].as_string()})")
        if name == "substring" and len(args) == 2:
            return _Value("string", f"substring({args[0].as_string()}, greatest({args[1].as_number()}, 1))")
        raise _Uncovered


def compile_path(path: str) -> tuple[str, str] | None:
    """SQL over ``nodes`` and ``tokens`` of what an XPath selects, or None if it is not covered.

    (``nodes``, an array of nids in document order) or (``strings``, an array of attribute values or texts).
    """
    try:
        return _Compiler(path).union()
    except _Uncovered:
        return None
