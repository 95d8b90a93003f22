"""HTML pages -> document trees.

The one Python step of the HTML operators: a tolerant, linear, row-local parse.  It
numbers the tree and nothing else; outlines, selectors, extraction, cleaning, skeletons
and Markdown are Catalyst expressions over its output.

One output row per page, two arrays:

``nodes``   one entry per element, position = ``nid`` in document order (root 0)
``tokens``  the document as a flat sequence: 0 open tag, 1 text, 2 close tag

``t0``/``t1`` of a node are the positions of its open and close token, so a subtree is a
slice of ``tokens`` and needs no walk.  ``last`` is the ``nid`` of its last descendant.
"""

from __future__ import annotations

import html as html_entities
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values: the element classes of the HTML syntax ----
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW_TEXT_TAGS = frozenset("script style".split())
ESCAPABLE_TEXT_TAGS = frozenset("title textarea".split())
HEAD_TAGS = frozenset("base link meta noscript script style title".split())
BLOCK_TAGS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section "
    "summary table ul".split()
)
INLINE_TAGS = frozenset(
    "a abbr b big cite code del em font i ins kbd mark q s samp small span strike strong sub "
    "sup tt u var".split()
)
# a start tag closes an open element of these kinds, looking no further up than the scope
CLOSED_BY_SIBLING = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table", "thead", "tbody", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
}
SCOPE_TAGS = frozenset("table td th caption button object html body".split())

OPEN, TEXT, CLOSE = 0, 1, 2

TREE_SCHEMA = (
    "nodes array<struct<nid:int,parent:int,depth:int,idx:int,tag:string,id:string,cls:string,"
    "attrs:map<string,string>,pos:int,total:int,cpos:int,ctotal:int,kids:array<int>,"
    "t0:int,t1:int,last:int>>, "
    "tokens array<struct<kind:int,nid:int,text:string>>"
)

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^\"'>]++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(
    r"([^\s=/\"'>][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?"
)


class _Tree:
    """Element stack of one page while its markup is read from left to right.

    ``open`` has the depths of the open elements of each tag name, so that an end tag or an implied close
    finds its element without walking the stack, and a page takes time in proportion to its length.
    """

    def __init__(self, drop: frozenset[str], drop_blank: bool):
        self.drop, self.drop_blank = drop, drop_blank
        self.tag, self.parent, self.depth, self.attrs = [], [], [], []
        self.t0, self.t1, self.last = [], [], []
        self.kind, self.owner, self.text = [], [], []
        self.stack: list[int] = []
        self.names: list[str] = []
        self.open: defaultdict[str, list[int]] = defaultdict(list)
        self.pending: list[str] = []
        self.hidden = 0  # open elements inside a dropped subtree
        self.after_drop = False
        self.body = None

    # -- text ---------------------------------------------------------------
    def flush(self) -> None:
        if not self.pending:
            return
        text, self.pending = "".join(self.pending), []
        blank = not text.strip()
        if len(self.stack) < 2 or self.names[-1] == "head":
            if blank:
                return
            self.enter_body()
        if self.after_drop or self.hidden:
            self.after_drop = False
            return
        if blank and (self.drop_blank or (self.names[-1] == "body" and self.owner[-1] == 0)):
            return
        self.kind.append(TEXT)
        self.owner.append(self.stack[-1])
        self.text.append(text)

    # -- elements -----------------------------------------------------------
    def push(self, tag: str, attrs: list[tuple[str, str]]) -> None:
        if self.hidden or tag in self.drop and self.stack:
            self.hidden += 1
            self.enter(-1, tag)
            return
        self.after_drop = False
        nid = len(self.tag)
        self.tag.append(tag)
        self.parent.append(self.stack[-1] if self.stack else -1)
        self.depth.append(len(self.stack))
        self.attrs.append(attrs)
        self.t0.append(len(self.kind))
        self.t1.append(-1)
        self.last.append(-1)
        self.kind.append(OPEN)
        self.owner.append(nid)
        self.text.append(None)
        self.enter(nid, tag)

    def enter(self, nid: int, tag: str) -> None:
        self.open[tag].append(len(self.stack))
        self.stack.append(nid)
        self.names.append(tag)

    def pop(self) -> None:
        if self.pending:
            self.flush()
        nid = self.stack.pop()
        self.open[self.names.pop()].pop()
        if nid < 0:
            self.hidden -= 1
            self.after_drop = not self.hidden
            return
        self.after_drop = False
        self.t1[nid] = len(self.kind)
        self.last[nid] = len(self.tag) - 1
        self.kind.append(CLOSE)
        self.owner.append(nid)
        self.text.append(None)

    def enter_body(self) -> None:
        if not self.stack:
            self.push("html", [])
        while len(self.stack) > 1 and self.body is None:
            self.pop()
        if self.body is None:
            self.push("body", [])
            self.body = self.stack[-1]

    def start(self, tag: str, attrs: list[tuple[str, str]], closed: bool) -> None:
        if self.pending:
            self.flush()
        if tag in ("html", "head", "body"):
            if tag == "html":
                if self.stack:
                    return
            elif self.body is not None or (tag == "head" and len(self.stack) > 1):
                return
            elif not self.stack:
                self.push("html", [])
            if tag == "body":
                while len(self.stack) > 1:
                    self.pop()
            self.push(tag, attrs)
            if tag == "body":
                self.body = self.stack[-1]
            return
        if self.body is None:
            if tag in HEAD_TAGS:
                if not self.stack:
                    self.push("html", [])
                if len(self.stack) == 1:
                    self.push("head", [])
            elif not self.open["head"] or self.names[-1] == "head":
                self.enter_body()
        self.close_implied(tag)
        self.push(tag, attrs)
        if tag in VOID_TAGS or closed:
            self.pop()

    def close_implied(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            depth = len(self.names) - 1
            while depth > 1 and self.names[depth] in INLINE_TAGS:
                depth -= 1
            if self.names[depth] == "p":
                depth -= 1
            self.close_to(depth)
            if self.open["p"]:
                self.close_open({"p"}, SCOPE_TAGS)
        elif tag in CLOSED_BY_SIBLING:
            self.close_open(*CLOSED_BY_SIBLING[tag])

    def innermost(self, kinds) -> int:
        """Depth of the innermost open element of ``kinds`` below the root, 0 if there is none."""
        return max((self.open[kind][-1] for kind in kinds if self.open[kind]), default=0)

    def close_open(self, kinds, scope) -> None:
        """Close up to the outermost open element of ``kinds`` inside ``scope``."""
        border, found = self.innermost(scope), None
        for kind in kinds:
            depths = self.open[kind]
            at = bisect_right(depths, border)
            if at < len(depths) and (found is None or depths[at] < found):
                found = depths[at]
        if found is not None:
            self.close_to(found - 1)

    def close_to(self, depth: int) -> None:
        while len(self.stack) - 1 > depth:
            self.pop()

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        depth = self.innermost((tag,))
        if depth and (tag not in INLINE_TAGS or depth > self.innermost(("td", "th", "table", "body"))):
            self.close_to(depth - 1)

    def finish(self) -> None:
        self.flush()
        if not self.stack:
            self.push("html", [])
        while self.stack:
            self.pop()


def _attributes(raw: str) -> list[tuple[str, str]]:
    seen: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(raw):
        name = name.lower()
        if name not in seen:
            value = double or single or bare
            seen[name] = html_entities.unescape(value) if "&" in value else value
    return list(seen.items())


def parse_page(
    page: str, drop: frozenset[str] = frozenset(), drop_blank: bool = False
) -> _Tree:
    """Parse one page; every input, also an empty one, yields a tree with a root."""
    page = page.replace("\r\n", "\n").replace("\r", "\n").replace("\x00", "")
    tree = _Tree(drop, drop_blank)
    at, size = 0, len(page)
    while at < size:
        found = _MARKUP.search(page, at)
        stop = found.start() if found else size
        if stop > at:
            text = page[at:stop]
            tree.pending.append(html_entities.unescape(text) if "&" in text else text)
        if not found:
            break
        at = found.end()
        closing, name, raw, other, other_raw = found.groups()
        if closing:
            if tree.pending:
                tree.flush()
            tree.end(closing.lower())
            continue
        name = name or other
        if not name:
            continue  # comment, doctype or processing instruction
        raw = (raw or other_raw or "").rstrip()
        tag = name.lower()
        tree.start(tag, _attributes(raw) if raw and raw != "/" else [], raw.endswith("/"))
        if (tag in RAW_TEXT_TAGS or tag in ESCAPABLE_TEXT_TAGS) and tree.names[-1] == tag:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            stop = close.start() if close else size
            if stop > at:
                text = page[at:stop]
                raw_text = tag in RAW_TEXT_TAGS or "&" not in text
                tree.pending.append(text if raw_text else html_entities.unescape(text))
            at = stop
            tree.flush()
    tree.finish()
    return tree


def markup_pieces(page: str) -> list[tuple[int, int, bool]]:
    """(start, end, is text) of the pieces of a page as the parser reads them, without gaps.

    A script, style or other element of raw text is one piece up to its end tag; comments and tags
    are one piece each.
    """
    out, at, size = [], 0, len(page)
    while at < size:
        found = _MARKUP.search(page, at)
        start = found.start() if found else size
        if start > at:
            out.append((at, start, True))
        if not found:
            break
        at = found.end()
        _, name, raw, other, other_raw = found.groups()
        tag, attributes = (name or other or "").lower(), (raw or other_raw or "").rstrip()
        if tag in RAW_TEXT_TAGS or tag in ESCAPABLE_TEXT_TAGS:
            if not attributes.endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
                at = close.start() if close else size
        out.append((start, at, False))
    return out


class _Columns:
    """Arrow builders for a bounded run of pages."""

    def __init__(self):
        self.rows: list[int] = []
        self.node_offsets, self.token_offsets = [0], [0]
        self.n = {k: [] for k in ("nid parent depth idx tag id cls pos total cpos ctotal "
                                  "t0 t1 last").split()}
        self.kid_offsets, self.kids = [0], []
        self.attr_offsets, self.attr_keys, self.attr_values = [0], [], []
        self.kind, self.owner, self.text = [], [], []

    def add(self, row: int, tree: _Tree) -> None:
        n, size = self.n, len(tree.tag)
        kids: list[list[int]] = [[] for _ in range(size)]
        pos, cpos, seen = [1] * size, [1] * size, {}
        ids, classes, idx = [None] * size, [None] * size, [0] * size
        for nid in range(size):
            attrs = dict(tree.attrs[nid])
            ids[nid], classes[nid] = attrs.get("id"), attrs.get("class")
            parent = tree.parent[nid]
            if parent >= 0:
                idx[nid] = len(kids[parent])
                kids[parent].append(nid)
            by_tag = (parent, tree.tag[nid])
            by_class = (parent, tree.tag[nid], classes[nid] or "")
            pos[nid] = seen[by_tag] = seen.get(by_tag, 0) + 1
            cpos[nid] = seen[by_class] = seen.get(by_class, 0) + 1
            self.attr_keys.extend(attrs.keys())
            self.attr_values.extend(attrs.values())
            self.attr_offsets.append(len(self.attr_keys))
        for nid in range(size):
            by_tag = (tree.parent[nid], tree.tag[nid])
            n["total"].append(seen[by_tag])
            n["ctotal"].append(seen[(*by_tag, classes[nid] or "")])
            self.kids.extend(kids[nid])
            self.kid_offsets.append(len(self.kids))
        for key, values in (("nid", range(size)), ("parent", tree.parent), ("depth", tree.depth),
                            ("idx", idx), ("tag", tree.tag), ("id", ids), ("cls", classes),
                            ("pos", pos), ("cpos", cpos), ("t0", tree.t0), ("t1", tree.t1),
                            ("last", tree.last)):
            n[key].extend(values)
        self.kind.extend(tree.kind)
        self.owner.extend(tree.owner)
        self.text.extend(tree.text)
        self.rows.append(row)
        self.node_offsets.append(len(n["nid"]))
        self.token_offsets.append(len(self.kind))

    def arrays(self) -> tuple[pa.Array, pa.Array]:
        ints, text = pa.int32(), pa.string()

        def offsets(values):
            return pa.array(values, ints)

        typed = {"tag": text, "id": text, "cls": text}
        fields = {k: pa.array(v, typed.get(k, ints)) for k, v in self.n.items()}
        fields["attrs"] = pa.MapArray.from_arrays(
            offsets(self.attr_offsets), pa.array(self.attr_keys, text), pa.array(self.attr_values, text)
        )
        fields["kids"] = pa.ListArray.from_arrays(offsets(self.kid_offsets), pa.array(self.kids, ints))
        order = ("nid parent depth idx tag id cls attrs pos total cpos ctotal kids "
                 "t0 t1 last").split()
        nodes = pa.StructArray.from_arrays([fields[k] for k in order], names=order)
        tokens = pa.StructArray.from_arrays(
            [pa.array(self.kind, ints), pa.array(self.owner, ints), pa.array(self.text, text)],
            names=["kind", "nid", "text"],
        )
        return (
            pa.ListArray.from_arrays(offsets(self.node_offsets), nodes),
            pa.ListArray.from_arrays(offsets(self.token_offsets), tokens),
        )


# characters of markup after which a parsed run of pages is handed to Spark
_RUN_CHARS = 4_000_000


def parse_pages(
    pages: DataFrame,
    html: str = "html",
    drop: tuple[str, ...] = (),
    drop_blank: bool = False,
) -> DataFrame:
    """Replace the ``html`` column by ``nodes`` and ``tokens``; map-only, no shuffle.

    ``drop`` names tags whose subtrees, with the text that follows them, are left out;
    ``drop_blank`` leaves out white-space text.  NULL markup is parsed as empty.
    """
    dropped = frozenset(drop)
    kept = [f for f in pages.schema.fields if f.name != html]
    schema = T.StructType(kept + T.StructType.fromDDL(TREE_SCHEMA).fields)
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            markup = batch.column(batch.schema.get_field_index(html))
            columns, chars = _Columns(), 0
            for row in range(batch.num_rows):
                page = markup[row].as_py() or ""
                columns.add(row, parse_page(page, dropped, drop_blank))
                chars += len(page)
                if chars >= _RUN_CHARS or row == batch.num_rows - 1:
                    first = batch.slice(columns.rows[0], len(columns.rows))
                    carried = [first.column(first.schema.get_field_index(n)) for n in names]
                    yield pa.RecordBatch.from_arrays(
                        [*carried, *columns.arrays()], names=[*names, "nodes", "tokens"]
                    )
                    columns, chars = _Columns(), 0

    return pages.select(*names, html).mapInArrow(run, schema)


def elements(trees: DataFrame, *keys: str) -> DataFrame:
    """The relational view: one row per element with the page keys in front."""
    return trees.select(*(keys or ("page_id",)), F.inline("nodes"))
