"""CSS selectors as XPath 1.0, for the native ``xpath`` function.

Covers type, ``*``, ``#id``, ``.class``, attribute tests, the four combinators, lists,
``:first-child``, ``:last-child``, ``:nth-child(k)``, ``:nth-of-type(k)`` and ``:not()`` of
one simple selector.  Anything else is rejected rather than answered wrongly.  A position
among siblings of a type is read from ``@__pos``, which the XHTML of a tree carries.
"""

from __future__ import annotations

import re

_SIMPLE = re.compile(
    r"""(?P<id>\#[\w-]+) | (?P<cls>\.[\w-]+)
      | \[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?P<q>["']?)(?P<val>[^\]]*?)(?P=q)\s*)?\]
      | :(?P<pseudo>first-child|last-child|nth-child|nth-of-type|not)(?:\((?P<arg>[^)]*)\))?
      | (?P<tag>\*|[a-zA-Z][\w-]*)""",
    re.X,
)
_COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")
_LIST = re.compile(r""",(?=(?:[^"']|"[^"]*"|'[^']*')*$)""")


def _literal(value: str) -> str:
    if "'" not in value:
        return f"'{value}'"
    if '"' not in value:
        return f'"{value}"'
    raise ValueError(f"unsupported selector value: {value}")


def _word(attr: str, value: str) -> str:
    spaced = _literal(f" {value} ")
    return f"contains(concat(' ', normalize-space(@{attr}), ' '), {spaced})"


def _attribute(name: str, op: str | None, value: str) -> str:
    if op is None:
        return f"@{name}"
    text = _literal(value)
    if op == "=":
        return f"@{name}={text}"
    if op == "~=":
        return _word(name, value)
    if op == "^=":
        return f"starts-with(@{name}, {text})"
    if op == "*=":
        return f"contains(@{name}, {text})"
    if op == "$=":
        return f"substring(@{name}, string-length(@{name}) - {len(value) - 1})={text}"
    return f"(@{name}={text} or starts-with(@{name}, {_literal(value + '-')}))"


def _compound(text: str) -> tuple[str, list[str]]:
    """Element name and predicates of one compound selector."""
    tag, tests, at = "*", [], 0
    while at < len(text):
        found = _SIMPLE.match(text, at)
        if not found or (found["tag"] and at):
            raise ValueError(f"unsupported selector: {text}")
        at = found.end()
        arg = (found["arg"] or "").strip()
        if found["tag"]:
            tag = found["tag"].lower()
        elif found["id"]:
            tests.append(f"@id={_literal(found['id'][1:])}")
        elif found["cls"]:
            tests.append(_word("class", found["cls"][1:]))
        elif found["attr"]:
            tests.append(_attribute(found["attr"].lower(), found["op"], found["val"] or ""))
        elif found["pseudo"] == "first-child":
            tests.append("not(preceding-sibling::*)")
        elif found["pseudo"] == "last-child":
            tests.append("not(following-sibling::*)")
        elif found["pseudo"] == "not":
            name, inner = _compound(arg)
            inner = inner + ([f"self::{name}"] if name != "*" else [])
            if len(inner) != 1:
                raise ValueError(f"unsupported selector: {text}")
            tests.append(f"not({inner[0]})")
        elif not arg.isdigit() or int(arg) < 1:
            raise ValueError(f"unsupported selector: {text}")
        elif found["pseudo"] == "nth-child":
            tests.append(f"count(preceding-sibling::*)={int(arg) - 1}")
        else:
            tests.append(f"@__pos={int(arg)}")
    return tag, tests


def _step(axis: str, text: str) -> str:
    tag, tests = _compound(text)
    return axis.format(tag) + "".join(f"[{t}]" for t in tests)


# ---- fixed values: how each combinator is written as an axis ----
_AXES = {
    " ": "//{}",
    ">": "/{}",
    "+": "/following-sibling::*[1][self::{0}]",
    "~": "/following-sibling::{}",
}


def css_to_xpath(selector: str) -> str:
    """Translate ``selector``; raises ``ValueError`` for what is not covered."""
    if not selector.strip():
        raise ValueError("the selector is empty")
    paths = []
    for part in _LIST.split(selector.strip()):
        part, path, at, axis = part.strip(), "", 0, " "
        if not part:
            raise ValueError(f"unsupported selector: {selector}")
        while at < len(part):
            start = at
            while at < len(part) and not _COMBINATOR.match(part, at):
                inner = re.compile(r"\[[^\]]*\]|\([^)]*\)|.", re.S).match(part, at)
                at = inner.end()
            path += _step(_AXES[axis], part[start:at])
            found = _COMBINATOR.match(part, at)
            if found:
                axis, at = found[1] or " ", found.end()
                if at >= len(part):
                    raise ValueError(f"unsupported selector: {selector}")
        paths.append(path)
    return " | ".join(paths)
