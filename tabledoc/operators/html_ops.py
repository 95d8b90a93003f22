"""Page operators over document trees (``html_tree.parse_pages``).

Everything is map-only: a page is one row, ancestors are reached by following ``parent``, subtrees are slices
of ``tokens``, and what needs order among siblings or elements (runs, first of its kind, what lies inside
what) is folded over the page's own arrays.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabledoc.operators.css_select import css_to_xpath
from tabledoc.operators.html_tree import VOID_TAGS, parse_pages
from tabledoc.operators.node_paths import compile_path

# ---- fixed values of the page operators ----
SKELETON_SKIP = ("script", "style", "meta", "link", "noscript")
NOTABLE_ATTRIBUTES = ("data-testid", "data-id", "role", "aria-label")
CLEAN_DROP = (
    "head", "script", "style", "noscript", "iframe", "canvas", "svg",
    "video", "audio", "source", "track", "map", "area",
)
CLEAN_KEEP = ("id", "class", "name", "type", "value")
SKELETON_DEPTH = 10
HEADING_TEXT_CHARS = 80
MARKDOWN_VIEW_CHARS = 10_000
MARKDOWN_VIEW_HEADINGS = 20
NO_HEADINGS = "(No headings found)"
VIEW_CUT = "...(truncated due to max length)..."
VIEW_TITLE = "Markdown view of "
VIEW_UNKNOWN = "unknown"
VIEW_SIZE = "Size: "
VIEW_SIZE_UNIT = " characters"
VIEW_HEADINGS = "Headings structure:"
VIEW_CONTENT = "Full markdown content:"
REPORT_NONE = "No elements found matching XPath: "
REPORT_FOUND = "Found "
REPORT_MATCHING = " element(s) matching "


def _sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_VOID = _sql_list(sorted(VOID_TAGS))
_SKIP = _sql_list(SKELETON_SKIP)
_HEADINGS = "'h1', 'h2', 'h3', 'h4', 'h5', 'h6'"
_TRIM = r"r'(?U)^\s+|\s+$'"


# --------------------------------------------------------------- paths

# SQL over one node ``c``: its step in a path and whether the path starts here
_XPATH_STEP = """concat(c.tag, CASE
    WHEN c.id <> '' AND instr(c.id, "'") > 0 THEN concat('[@id="', c.id, '"]')
    WHEN c.id <> '' THEN concat("[@id='", c.id, "']")
    WHEN c.total > 1 THEN concat('[', c.pos, ']') ELSE '' END)"""
_GENERAL_STEP = """concat(c.tag, CASE
    WHEN c.id <> '' AND instr(c.id, "'") > 0 THEN concat('[@id="', c.id, '"]')
    WHEN c.id <> '' THEN concat("[@id='", c.id, "']")
    WHEN c.cls <> '' AND instr(c.cls, "'") = 0 THEN concat("[@class='", c.cls, "']") ELSE '' END)"""
_CLASSES = r"""array_join(transform(slice(filter(split(coalesce(c.cls, ''), r'\s+'), k -> k <> ''), 1, 2),
    k -> concat('.', k)), '')"""
_CSS_STEP = f"""concat(c.tag, {_CLASSES}, CASE
    WHEN c.total <= 1 THEN ''
    WHEN c.cls <> '' AND c.ctotal > 1 THEN concat(':nth-of-type(', c.cpos, ')')
    WHEN c.cls <> '' THEN ''
    ELSE concat(':nth-of-type(', c.pos, ')') END)"""
_CSS_STEP_UNIQUE = f"""CASE WHEN c.id <> '' THEN concat('#', c.id) ELSE
    concat(c.tag, {_CLASSES}, CASE WHEN c.total > 1 THEN concat(':nth-of-type(', c.pos, ')')
    ELSE '' END) END"""


def _path(node: str, step: str, joiner: str) -> str:
    """SQL: steps from the nearest ancestor-or-self with an id (or below the root) to ``node``.

    ``aggregate`` follows ``parent`` for as many steps as the element is deep.
    """
    here = "nodes[up.cur]"
    at = re.sub(r"\bc\.", here + ".", step)
    return f"""aggregate(sequence(0, {node}.depth),
        named_struct('cur', {node}.nid, 'path', ''),
        (up, i) -> CASE WHEN up.cur <= 0 THEN up ELSE named_struct(
            'cur', CASE WHEN {here}.id <> '' THEN 0 ELSE {here}.parent END,
            'path', concat({at}, CASE WHEN up.path = '' THEN '' ELSE '{joiner}' END, up.path)) END
    ).path"""


def xpath_of(node: str = "n") -> str:
    """SQL text of the unique XPath of a node."""
    return f"concat(CASE WHEN {node}.nid = 0 THEN '/' ELSE '//' END, {_path(node, _XPATH_STEP, '/')})"


def css_of(node: str = "n", unique: bool = False) -> str:
    """SQL text of the CSS selector of a node."""
    step = _CSS_STEP_UNIQUE if unique else _CSS_STEP
    return (
        f"CASE WHEN {node}.id <> '' THEN concat('#', {node}.id) "
        f"ELSE {_path(node, step, ' > ')} END"
    )


def element_paths(trees: DataFrame, key: str = "page_id", unique: bool = False) -> DataFrame:
    """XPath and CSS selector of every element: (key, nid, tag, xpath, css)."""
    return trees.select(
        key,
        F.expr(
            f"inline(transform(nodes, n -> named_struct('nid', n.nid, 'tag', n.tag, "
            f"'xpath', {xpath_of()}, 'css', {css_of(unique=unique)})))"
        ),
    )


# --------------------------------------------------------------- text and markup

def _slice(node: str, tail: bool = False) -> str:
    """SQL: the tokens of a subtree, with the text after it when ``tail``."""
    own = f"slice(tokens, {node}.t0 + 1, {node}.t1 - {node}.t0 + 1)"
    if not tail:
        return own
    # get() is NULL past the end; the token after a close token is its tail text or markup
    return (
        f"slice(tokens, {node}.t0 + 1, {node}.t1 - {node}.t0 + 1 + "
        f"CASE WHEN get(tokens, {node}.t1 + 1).kind = 1 THEN 1 ELSE 0 END)"
    )


def text_of(node: str = "n") -> str:
    """SQL: all text of a subtree, untouched."""
    return f"array_join(transform(filter({_slice(node)}, t -> t.kind = 1), t -> t.text), '')"


def words_of(node: str = "n") -> str:
    """SQL: the non-blank text pieces of a subtree, stripped and joined by one space.

    Script and style text counts only when the node itself is such an element.
    """
    return rf"""array_join(filter(transform(filter({_slice(node)},
        t -> t.kind = 1 AND (nodes[t.nid].tag NOT IN ('script', 'style') OR t.nid = {node}.nid)),
        t -> regexp_replace(t.text, {_TRIM}, '')), w -> w <> ''), ' ')"""


_ESCAPED_TEXT = (
    "CASE WHEN nodes[t.nid].tag IN ('script', 'style') THEN t.text ELSE "
    "replace(replace(replace(t.text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') END"
)
_ATTRIBUTES = """array_join(transform(map_entries(nodes[t.nid].attrs), a -> concat(' ', a.key, '="',
    replace(replace(a.value, '&', '&amp;'), '"', '&quot;'), '"')), '')"""
_MARKUP = f"""CASE t.kind
    WHEN 0 THEN concat('<', nodes[t.nid].tag, {_ATTRIBUTES}, '>')
    WHEN 1 THEN {_ESCAPED_TEXT}
    ELSE CASE WHEN nodes[t.nid].tag IN ({_VOID}) THEN '' ELSE concat('</', nodes[t.nid].tag, '>') END END"""


def markup_of(node: str = "n", tail: bool = False) -> str:
    """SQL: outer HTML of a node."""
    return f"array_join(transform({_slice(node, tail)}, t -> {_MARKUP}), '')"


# XML has no place for these characters and names; the pages are untrusted input
_NOT_XML = r"r'[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]'"
_XML_NAME = r"r'^[A-Za-z_][A-Za-z0-9_.:-]*$'"


def _xml_text(value: str) -> str:
    out = f"regexp_replace({value}, {_NOT_XML}, '')"
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = f"replace({out}, '{raw}', '{entity}')"
    return out


_XML_TAG = r"regexp_replace(nodes[t.nid].tag, r'[^A-Za-z0-9_.:-]', '_')"
_XHTML = f"""array_join(transform(tokens, t -> CASE t.kind
    WHEN 0 THEN concat('<', {_XML_TAG}, array_join(transform(
        filter(map_entries(nodes[t.nid].attrs), a -> a.key RLIKE {_XML_NAME}
            AND a.key NOT IN ('__nid', '__pos') AND a.key NOT LIKE 'xmlns%'),
        a -> concat(' ', a.key, '="', {_xml_text('a.value')}, '"')), ''),
        ' __nid="', t.nid, '" __pos="', nodes[t.nid].pos, '">')
    WHEN 1 THEN {_xml_text('t.text')}
    ELSE concat('</', {_XML_TAG}, '>') END), '')"""


def with_xhtml(trees: DataFrame) -> DataFrame:
    """Add ``xhtml``: a well-formed serialisation, each element with its ``__nid`` and ``__pos``."""
    return trees.withColumn("xhtml", F.expr(_XHTML))


# --------------------------------------------------------------- Markdown

# \u0001 paragraph break, \u0002 line break, \u0003 kept space; all removed at the end
_P, _L, _S = "\x01", "\x02", "\x03"
_LIST_LEVEL = """aggregate(sequence(0, nodes[t.nid].depth), named_struct('cur', nodes[t.nid].parent, 'k', 0),
    (up, i) -> CASE WHEN up.cur < 0 THEN up ELSE named_struct('cur', nodes[up.cur].parent,
        'k', up.k + CASE WHEN nodes[up.cur].tag IN ('ul', 'ol') THEN 1 ELSE 0 END) END).k"""


def _inside(*tags: str) -> str:
    return f"""(aggregate(sequence(0, nodes[t.nid].depth), t.nid, (up, i) -> CASE
        WHEN up < 0 OR nodes[up].tag IN ({_sql_list(tags)}) THEN up ELSE nodes[up].parent END) >= 0)"""


_PARAGRAPHS = _sql_list(
    "address article aside dd details div dl dt fieldset figcaption figure footer form header "
    "main nav p section summary table thead tbody tfoot caption".split()
)
_FIRST_ROW = """(nodes[t.nid].tag = 'tr' AND nodes[t.nid].pos = 1 AND (nodes[nodes[t.nid].parent].tag IN ('table', 'thead')
    OR (nodes[nodes[t.nid].parent].tag = 'tbody' AND nodes[nodes[t.nid].parent].idx = 0)))"""
_MARKDOWN = rf"""CASE
    WHEN {_inside('script', 'style', 'head')} THEN ''
    WHEN t.kind = 1 AND {_inside('pre')} THEN replace(t.text, ' ', '{_S}')
    WHEN t.kind = 1 THEN regexp_replace(regexp_replace(t.text, r'[\x00-\x08]', ''), r'\s+', ' ')
    WHEN nodes[t.nid].tag RLIKE '^h[1-6]$' THEN CASE t.kind WHEN 0 THEN
        concat('{_P}', repeat('#', cast(right(nodes[t.nid].tag, 1) AS int)), '{_S}') ELSE '{_P}' END
    WHEN nodes[t.nid].tag IN ('b', 'strong') THEN '**'
    WHEN nodes[t.nid].tag IN ('i', 'em', 'u') THEN '_'
    WHEN nodes[t.nid].tag IN ('code', 'tt', 'kbd', 'samp') THEN CASE WHEN {_inside('pre')} THEN '' ELSE '`' END
    WHEN nodes[t.nid].tag = 'a' THEN CASE WHEN element_at(nodes[t.nid].attrs, 'href') IS NULL THEN ''
        WHEN t.kind = 0 THEN '[' ELSE concat('](', element_at(nodes[t.nid].attrs, 'href'), ')') END
    WHEN nodes[t.nid].tag = 'img' THEN CASE WHEN t.kind = 0 AND element_at(nodes[t.nid].attrs, 'src') IS NOT NULL THEN
        concat('![', coalesce(element_at(nodes[t.nid].attrs, 'alt'), ''), '](', element_at(nodes[t.nid].attrs, 'src'), ')')
        ELSE '' END
    WHEN nodes[t.nid].tag = 'br' THEN CASE t.kind WHEN 0 THEN '{_S}{_S}{_L}' ELSE '' END
    WHEN nodes[t.nid].tag = 'hr' THEN CASE t.kind WHEN 0 THEN '{_P}*{_S}*{_S}*{_P}' ELSE '' END
    WHEN nodes[t.nid].tag = 'pre' THEN CASE t.kind WHEN 0 THEN '{_P}```\n' ELSE '\n```{_P}' END
    WHEN nodes[t.nid].tag = 'blockquote' THEN CASE t.kind WHEN 0 THEN '{_P}>{_S}' ELSE '{_P}' END
    WHEN nodes[t.nid].tag IN ('ul', 'ol') THEN CASE WHEN {_LIST_LEVEL} = 0 THEN '{_P}' ELSE '{_L}' END
    WHEN nodes[t.nid].tag = 'li' THEN CASE t.kind WHEN 1 THEN '' WHEN 2 THEN '{_L}' ELSE
        concat('{_L}', repeat('{_S}', 2 * greatest(1, {_LIST_LEVEL})),
            CASE WHEN nodes[nodes[t.nid].parent].tag = 'ol' THEN concat(nodes[t.nid].pos, '.{_S}') ELSE '*{_S}' END) END
    WHEN nodes[t.nid].tag IN ('td', 'th') THEN CASE WHEN t.kind = 2 AND
        nodes[t.nid].idx < size(nodes[nodes[t.nid].parent].kids) - 1 THEN '{_S}|{_S}' ELSE '' END
    WHEN nodes[t.nid].tag = 'tr' THEN CASE t.kind WHEN 0 THEN '{_L}' ELSE CASE WHEN {_FIRST_ROW} AND size(nodes[t.nid].kids) > 0
        THEN concat('{_L}', array_join(array_repeat('---', size(nodes[t.nid].kids)), '|')) ELSE '' END END
    WHEN nodes[t.nid].tag IN ({_PARAGRAPHS}) THEN '{_P}'
    ELSE '' END"""


def _tidy_markdown(joined: str) -> str:
    return (
        f"translate(regexp_replace(regexp_replace(regexp_replace({joined}, "
        f"' *(?:{_L} *)*{_P}[ {_P}{_L}]*', '\\n\\n'), ' *{_L}[ {_L}]*', '\\n'), "
        f"r'^[\\n ]+|[\\n ]+$', ''), '{_S}', ' ')"
    )


def markdown_of(node: str = "n") -> str:
    """SQL: Markdown of a node."""
    return _tidy_markdown(f"array_join(transform({_slice(node)}, t -> {_MARKDOWN}), '')")


def html_markdown(trees: DataFrame, *keys: str) -> DataFrame:
    """Pages as Markdown: keys + ``markdown``."""
    whole = _tidy_markdown(f"array_join(transform(tokens, t -> {_MARKDOWN}), '')")
    return trees.select(*(keys or ("page_id",)), F.expr(whole).alias("markdown"))


def markdown_view(
    pages: DataFrame, markdown: str = "markdown", url: str = "url", max_chars: int | None = None, max_headings: int | None = None
) -> DataFrame:
    """Add ``view``: heading list with line numbers, then the body.

    ``size`` is the full length.  ``max_chars`` and ``max_headings`` cut the view where they are
    given; ``markdown`` stays whole.
    """
    from tabledoc.operators.text_ops import headings_of

    shown = 2**31 - 1 if max_headings is None else max_headings
    listing = f"""concat(
        array_join(transform(slice(heads, 1, {shown}), h -> concat(repeat('  ', h.level - 1),
            repeat('#', h.level), ' ', h.text, ' (line ', h.line, ')')), '\\n'),
        CASE WHEN size(heads) > {shown} THEN concat('\\n  ... and ', size(heads) - {shown}, ' more headings') ELSE '' END)"""
    body = markdown if max_chars is None else (
        f"CASE WHEN length({markdown}) > {max_chars} THEN concat(left({markdown}, "
        f"{max_chars}), '\\n\\n{VIEW_CUT}') ELSE {markdown} END"
    )
    return (
        pages.withColumn("heads", F.expr(headings_of(markdown)))
        .withColumn("size", F.length(markdown))
        .withColumn(
            "view",
            F.expr(
                f"concat('{VIEW_TITLE}', coalesce({url}, '{VIEW_UNKNOWN}'), '\\n{VIEW_SIZE}', size, "
                f"'{VIEW_SIZE_UNIT}\\n\\n{VIEW_HEADINGS}\\n', CASE WHEN size(heads) = 0 THEN "
                f"'{NO_HEADINGS}' ELSE {listing} END, '\\n\\n{VIEW_CONTENT}\\n', {body})"
            ),
        )
        .drop("heads")
    )


# --------------------------------------------------------------- outline

def _heading_nodes() -> str:
    return rf"""filter(transform(filter(nodes, n -> n.tag RLIKE '^h[1-6]$'), n -> named_struct(
        'level', cast(right(n.tag, 1) AS int),
        'text', regexp_replace({text_of()}, {_TRIM}, ''),
        'xpath', {xpath_of()}, 'css', {css_of()})), h -> h.text <> '')"""


def page_headings(trees: DataFrame, key: str = "page_id") -> DataFrame:
    """Headings in document order: (key, ord, level, text, xpath, css)."""
    return trees.select(
        key,
        F.expr(
            f"inline(transform({_heading_nodes()}, (h, i) -> named_struct('ord', i + 1, "
            "'level', h.level, 'text', h.text, 'xpath', h.xpath, 'css', h.css)))"
        ),
    )


def outline_of() -> str:
    """SQL: the heading outline of a tree, two lines per heading."""
    lines = f"""array_join(transform({_heading_nodes()}, h -> concat(
        repeat('  ', h.level - 1), repeat('#', h.level), ' ', h.text, '\\n',
        repeat('  ', h.level - 1), '   XPath: ', h.xpath)), '\\n')"""
    return f"coalesce(nullif({lines}, ''), '{NO_HEADINGS}')"


def html_outline(trees: DataFrame, *keys: str) -> DataFrame:
    """Heading outline of each page: keys + ``outline``; map-only."""
    return trees.select(*(keys or ("page_id",)), F.expr(outline_of()).alias("outline"))


# --------------------------------------------------------------- extraction

# the last step of a path that yields strings instead of elements
_STRING_RESULT = re.compile(r"(?:@[\w:.*-]+|text\(\))\s*\)?\s*$")
_SCALAR_RESULT = re.compile(
    r"^\s*(?:count|sum|number|string|string-length|concat|normalize-space|substring\S*|"
    r"boolean|not|true|false|floor|ceiling|round|contains|starts-with|name|local-name|position|last)\s*\("
)
EXTRACT_MODES = {
    "text": words_of("nodes[k]"),
    "html": markup_of("nodes[k]", tail=True),
    "outer_html": markup_of("nodes[k]"),
    "markdown": markdown_of("nodes[k]"),
    "attrs": "to_json(nodes[k].attrs)",
}


def _matches(trees: DataFrame, xpath: str, mode: str) -> DataFrame:
    """Trees with ``hits``: the extracted values of each page in document order."""
    if mode not in EXTRACT_MODES:
        raise ValueError(f"unknown extract mode {mode!r}: use one of {sorted(EXTRACT_MODES)}")
    if not xpath.strip():
        raise ValueError("the XPath expression is empty")
    if _SCALAR_RESULT.match(xpath):
        raise ValueError(f"{xpath!r} does not select nodes: use a path")
    compiled = compile_path(xpath)
    return _by_arrays(trees, *compiled, mode) if compiled else _by_xml(trees, xpath, mode)


def _by_arrays(trees: DataFrame, kind: str, found: str, mode: str) -> DataFrame:
    if kind == "strings":
        return trees.withColumn("hits", F.expr(found))
    return trees.withColumn("found", F.expr(found)).withColumn("hits", F.expr(f"transform(found, k -> {EXTRACT_MODES[mode]})"))


def _by_xml(trees: DataFrame, xpath: str, mode: str) -> DataFrame:
    """By the native ``xpath`` function over the page written as XML, for what the arrays do not answer."""
    pages = with_xhtml(trees)
    if _STRING_RESULT.search(xpath):
        own = xpath.replace("@*", "@*[not(starts-with(name(), '__'))]")
        return pages.withColumn("hits", F.xpath("xhtml", F.lit(own)))
    nids = F.xpath("xhtml", F.lit(f"({xpath})/@__nid"))
    pages = pages.withColumn("found", nids.cast("array<int>"))
    return pages.withColumn("hits", F.expr(f"transform(found, k -> {EXTRACT_MODES[mode]})"))


def xpath_extract(trees: DataFrame, xpath: str, mode: str = "markdown", key: str = "page_id") -> DataFrame:
    """One row per element selected by ``xpath``: (key, i, value); pages without one have none."""
    return _matches(trees, xpath, mode).select(
        key, F.posexplode("hits").alias("i", "value")
    )


def css_extract(trees: DataFrame, selector: str, mode: str = "text", key: str = "page_id") -> DataFrame:
    """As ``xpath_extract`` for a CSS selector (``html`` is then without the text after it)."""
    mode = "outer_html" if mode == "html" else mode
    return xpath_extract(trees, css_to_xpath(selector), mode, key)


def extraction_report(trees: DataFrame, xpath: str, mode: str = "markdown", key: str = "page_id") -> DataFrame:
    """The numbered listing of a page's matches, or the sentence that there is none."""
    shown = xpath.replace("\\", "\\\\").replace("'", "\\'")
    return _matches(trees, xpath, mode).select(
        key,
        F.expr(
            f"CASE WHEN size(hits) = 0 THEN '{REPORT_NONE}{shown}' ELSE "
            f"concat('{REPORT_FOUND}', size(hits), '{REPORT_MATCHING}\\'{shown}\\':\\n\\n', "
            "array_join(transform(hits, (v, i) -> concat('[', i, '] ', v)), '\\n')) END"
        ).alias("report"),
    )


def element_values(trees: DataFrame, what: str, key: str = "page_id", tag: str | None = None) -> DataFrame:
    """``text`` or ``html`` of every element (of one tag, if given): (key, nid, tag, value).

    The values of nested elements repeat each other, so without a tag the output is up to tree depth
    times the page.  Elements of other tags are left out before any value is made.
    """
    nodes = "nodes" if tag is None else f"filter(nodes, n -> n.tag = '{tag}')"
    value = {"text": words_of(), "html": markup_of(tail=True)}[what]
    return trees.select(
        key,
        F.expr(
            f"inline(transform({nodes}, n -> named_struct('nid', n.nid, 'tag', n.tag, 'value', {value})))"
        ),
    )


def xpath_candidates(trees: DataFrame, pattern: str, key: str | None = None) -> DataFrame:
    """Index-free paths of elements whose own text, class or id matches ``pattern``.

    Result (xpath, n, n_pages, sample), over all pages or per page with ``key``; counting is
    partially aggregated before the exchange.
    """
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    own = (
        f"array_join(transform(filter({_slice('n')}, t -> t.kind = 1 AND t.nid = n.nid), t -> t.text), '')"
    )
    found = trees.select(
        "page_id",
        F.expr(
            f"inline(filter(transform(filter(nodes, n -> n.nid > 0), n -> named_struct("
            f"'xpath', concat('//', {_path('n', _GENERAL_STEP, '/')}), 'own', {own}, "
            f"'label', concat_ws(' ', n.cls, n.id))), m -> m.own RLIKE '(?i){quoted}' "
            f"OR m.label RLIKE '(?i){quoted}'))"
        ),
    )
    group = [key, "xpath"] if key else ["xpath"]
    return found.groupBy(*group).agg(
        F.count("*").alias("n"),
        F.count_distinct("page_id").alias("n_pages"),
        F.min("own").alias("sample"),
    )


# --------------------------------------------------------------- folding over a page's arrays

def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _outside(values: str, intervals: str) -> str:
    """SQL: the parts of an array outside of all ``intervals``, joined.

    The intervals are (start, stop) of positions, ordered by start, nested or apart.  One that lies in none
    before it is told by the greatest stop so far, taken block by block, so the work for n intervals is n * sqrt(n).
    """
    so_far = "greatest(past[CAST(i DIV width AS int)], coalesce(array_max(slice(stops, CAST((i DIV width) * width + 1 AS int), CAST(i % width AS int))), -1))"
    outer = _let(
        "stops", "transform(hid, h -> h.stop)", _let(
            "width", "greatest(1, CAST(sqrt(size(stops)) AS int))", _let(
                "most", "transform(sequence(0, CAST(size(stops) DIV width AS int)), b -> array_max(slice(stops, b * width + 1, width)))", _let(
                    "past", "transform(sequence(0, size(most)), b -> coalesce(array_max(slice(most, 1, b)), -1))",
                    f"filter(hid, (h, i) -> h.start > {so_far})",
                ),
            ),
        ),
    )
    start = "CASE WHEN g = 0 THEN 0 ELSE gone[g - 1].stop + 1 END"
    parts = f"flatten(transform(sequence(0, size(gone)), g -> slice(whole, {start} + 1, coalesce(get(gone, g).start, size(whole)) - {start})))"
    return _let("whole", values, _let("hid", intervals, _let("gone", outer, parts)))


# --------------------------------------------------------------- skeleton

def _kept(kids: str) -> str:
    return f"filter({kids}, k -> nodes[k].tag NOT IN ({_SKIP}))"


_KEPT_COUNT = f"size({_kept('n.kids')})"
_CLASS_NAMES = r"filter(split(coalesce(n.cls, ''), r'\s+'), c -> c <> '')"
_NOTABLE = "filter(array(" + ", ".join(
    f"CASE WHEN element_at(n.attrs, '{a}') <> '' THEN "
    f"concat('{a}=\"', element_at(n.attrs, '{a}'), '\"') END"
    for a in NOTABLE_ATTRIBUTES
) + "), a -> a IS NOT NULL)"
_LABEL = _let("classes", _CLASS_NAMES, _let("notable", _NOTABLE, """concat(n.tag,
    CASE WHEN n.id <> '' THEN concat('#', n.id) ELSE '' END,
    CASE WHEN size(classes) > 0 THEN concat('.', array_join(slice(classes, 1, 2), '.')) ELSE '' END,
    CASE WHEN size(classes) > 2 THEN concat('(+', size(classes) - 2, ')') ELSE '' END,
    CASE WHEN size(notable) > 0 THEN concat(' [', array_join(slice(notable, 1, 2), ', '), ']') ELSE '' END)"""))
# the heading text joins stripped pieces without a separator
_HEADING_TEXT = rf"""array_join(transform(filter({_slice('n')}, t -> t.kind = 1),
    t -> regexp_replace(t.text, {_TRIM}, '')), '')"""
_ALIKE_GRANDCHILDREN = f"""CASE WHEN size(array_distinct(transform({_kept('n.kids')}, g -> named_struct(
    'tag', nodes[g].tag, 'n', size({_kept('nodes[g].kids')}))))) = 1
    THEN concat(' [', {_KEPT_COUNT}, ' ', nodes[{_kept('n.kids')}[0]].tag, ']') ELSE '' END"""

# of every element: its number of kept children, whether it stands alone among its siblings, whether it is skipped
_FACTS = f"""transform(nodes, n -> named_struct('kept', {_KEPT_COUNT},
    'alone', coalesce(n.id <> '', false) OR n.tag IN ({_HEADINGS}), 'skip', n.tag IN ({_SKIP})))"""
# a run begins where two neighbours differ or one of them stands alone
_RUN_BEGINS = """i = 0 OR facts[sibs[i]].alone OR facts[get(sibs, i - 1)].alone OR nodes[sibs[i]].tag <> nodes[get(sibs, i - 1)].tag
    OR facts[sibs[i]].kept <> facts[get(sibs, i - 1)].kept"""
_MEMBERS = _let("past", "coalesce(get(begins, j + 1), size(sibs))", """transform(slice(sibs, b + 1, past - b), (k, p) ->
    named_struct('nid', k, 'run', j + 1, 'len', past - b, 'pos', p + 1, 'closing', past = size(sibs), 'ends', b + p + 1 = size(sibs)))""")
_RUNS_BELOW = _let("sibs", _kept("n.kids"), f"""CASE WHEN size(sibs) > 0 THEN {_let(
    "begins", f"filter(sequence(0, size(sibs) - 1), i -> {_RUN_BEGINS})", f"flatten(transform(begins, (b, j) -> {_MEMBERS}))")} END""")
# in document order, one for each element; skipped ones are in a run of length 0
_RUNS = f"""array_sort(concat(
    array(named_struct('nid', 0, 'run', 1, 'len', 1, 'pos', 1, 'closing', true, 'ends', true)),
    flatten(array_compact(transform(nodes, n -> {_RUNS_BELOW}))),
    transform(filter(nodes, n -> n.nid > 0 AND facts[n.nid].skip),
        n -> named_struct('nid', n.nid, 'run', 0, 'len', 0, 'pos', 0, 'closing', false, 'ends', false))))"""


def sibling_runs(trees: DataFrame, key: str = "page_id") -> DataFrame:
    """Gaps and islands among siblings: (key, nid, parent, tag, run_no, run_len, run_pos).

    Siblings next to each other are alike with the same tag and number of kept children; elements with an id and
    headings stand alone; skipped elements are in no run and do not part one.
    """
    runs = _let("facts", _FACTS, _RUNS)
    return trees.select(
        key,
        F.expr(
            f"inline(transform(filter({runs}, r -> r.len > 0), r -> named_struct('nid', r.nid, 'parent', nodes[r.nid].parent, "
            "'tag', nodes[r.nid].tag, 'run_no', r.run, 'run_len', r.len, 'run_pos', r.pos)))"
        ),
    )


def skeleton_of(max_depth: int | None = None, compact_threshold: int = 3, heading_chars: int | None = None) -> str:
    """SQL: the skeleton of a tree.

    Runs of ``compact_threshold`` alike siblings or more are one line; ``max_depth`` and ``heading_chars`` cut.
    """
    folded = f"(NOT facts[r.nid].alone AND r.len >= {int(compact_threshold)})"
    # a folded or skipped element hides everything below it
    hidden = f"""filter(transform(filter(runs, r -> facts[r.nid].skip OR {folded}), r -> named_struct('start', r.nid + 1, 'stop', nodes[r.nid].last)),
        h -> h.start <= h.stop)"""
    deep = "true" if max_depth is None else f"nodes[r.nid].depth <= {int(max_depth)} + CASE WHEN {folded} THEN 1 ELSE 0 END"
    shown = f"filter({_outside('runs', hidden)}, r -> r.len > 0 AND {deep} AND (r.pos = 1 OR NOT {folded}))"
    head = _HEADING_TEXT if heading_chars is None else f"left({_HEADING_TEXT}, {int(heading_chars)})"
    heading = f"""CASE WHEN n.tag IN ({_HEADINGS}) THEN {_let("head", head, "CASE WHEN head <> '' THEN concat(' → \"', head, '\"') ELSE '' END")} ELSE '' END"""
    line = f"""concat(repeat('  ', n.depth),
        CASE WHEN n.depth = 0 THEN '' WHEN CASE WHEN {folded} THEN r.closing ELSE r.ends END THEN '└── ' ELSE '├── ' END, {_LABEL},
        CASE WHEN {folded} THEN concat({_ALIKE_GRANDCHILDREN}, ' × ', r.len)
        ELSE concat(CASE WHEN facts[n.nid].kept > 0 THEN concat(' (', facts[n.nid].kept, ' children)') ELSE '' END, {heading}) END)"""
    lines = f"transform({shown}, r -> {_let('n', 'nodes[r.nid]', line)})"
    return _let("facts", _FACTS, _let("runs", _RUNS, f"array_join({lines}, '\\n')"))


def dom_skeleton(
    trees: DataFrame,
    max_depth: int | None = None,
    compact_threshold: int = 3,
    key: str = "page_id",
    heading_chars: int | None = None,
    **carried: str,
) -> DataFrame:
    """Tree text of each page: (key, skeleton, carried); ``carried`` names SQL over the tree."""
    text = skeleton_of(max_depth, compact_threshold, heading_chars)
    return trees.select(key, F.expr(text).alias("skeleton"), *[F.expr(sql).alias(name) for name, sql in carried.items()])


def page_overview(
    trees: DataFrame, key: str = "page_id", max_depth: int | None = None, heading_chars: int | None = None, **carried: str
) -> DataFrame:
    """Outline and skeleton of each page from one parse."""
    return dom_skeleton(trees, max_depth, key=key, heading_chars=heading_chars, outline=outline_of(), **carried)


# --------------------------------------------------------------- cleaning

# tag, class and text of an element, the text as a hash with its length
_KIND = "named_struct('tag', nodes[{0}].tag, 'cls', nodes[{0}].cls, 'sig', xxhash64(words), 'chars', length(words))"


def cleaned_of(text_threshold: int = 100, attr_value_threshold: int = 200) -> str:
    """SQL: the markup of a tree reduced to structure.

    Head, scripts and media are left out with the text that follows them, as is blank text; attributes are filtered and
    cut, text is cut, and of the elements with equal tag, class and text only the first stays.
    """
    tail = "CASE WHEN get({0}, {1} + 1).kind = 1 THEN 1 ELSE 0 END"
    dropped = f"""transform(filter(nodes, n -> n.nid > 0 AND n.tag IN ({_sql_list(CLEAN_DROP)})),
        n -> named_struct('start', n.t0, 'stop', n.t1 + {tail.format('tokens', 'n.t1')}))"""
    strip = rf"regexp_replace(t.text, {_TRIM}, '')"
    cut_text = f"""CASE WHEN t.kind = 1 AND length(t.text) > {int(text_threshold)} AND (t.nid > 0 OR i > 1) AND length({strip}) > {int(text_threshold)}
        THEN concat(left({strip}, {int(text_threshold)}), '...') ELSE t.text END"""
    said = rf"filter({_outside('tokens', dropped)}, t -> t.kind <> 1 OR ascii(t.text) BETWEEN 33 AND 126 OR NOT t.text RLIKE r'(?U)\A[\s\x1c-\x1f]*\z')"
    rest = f"transform({said}, (t, i) -> named_struct('kind', t.kind, 'nid', t.nid, 'text', {cut_text}, 'i', i))"
    # open and close token of every element with a class, in document order
    classed = "filter(rest, t -> t.kind = {0} AND t.nid > 0 AND nodes[t.nid].cls <> '')"
    ends = f"array_sort(transform({classed.format(2)}, t -> named_struct('nid', t.nid, 'i', t.i)))"
    pairs = f"zip_with({classed.format(0)}, {ends}, (a, b) -> named_struct('nid', a.nid, 'start', a.i, 'stop', b.i))"
    words = "array_join(transform(filter(slice(rest, c.start + 1, c.stop - c.start + 1), t -> t.kind = 1), t -> t.text), '')"
    # the removed part of a repeat reaches over the text that follows it
    element = f"named_struct('kind', {_KIND.format('c.nid')}, 'start', c.start, 'stop', c.stop + {tail.format('rest', 'c.stop')})"
    kinds = f"array_sort(transform({pairs}, c -> {_let('words', words, element)}))"
    again = "filter(kinds, (k, i) -> i > 0 AND get(kinds, i - 1).kind = k.kind)"
    repeats = _let("kinds", kinds, f"array_sort(transform({again}, k -> named_struct('start', k.start, 'stop', k.stop)))")
    attributes = f"""array_join(transform(filter(map_entries(nodes[t.nid].attrs),
        a -> t.nid = 0 OR a.key IN ({_sql_list(CLEAN_KEEP)}) OR a.key LIKE 'data-%'),
        a -> concat(' ', a.key, '="', replace(replace(CASE WHEN t.nid > 0 AND length(a.value) > {int(attr_value_threshold)}
            THEN concat(left(a.value, {int(attr_value_threshold)}), '...') ELSE a.value END,
            '&', '&amp;'), '"', '&quot;'), '"')), '')"""
    piece = _MARKUP.replace(_ATTRIBUTES, attributes)
    return _let("rest", rest, f"array_join(transform({_outside('rest', repeats)}, t -> {piece}), '')")


def html_clean(
    trees: DataFrame, text_threshold: int = 100, attr_value_threshold: int = 200, key: str = "page_id"
) -> DataFrame:
    """Markup reduced to structure, see ``cleaned_of``: (key, cleaned)."""
    return trees.select(key, F.expr(cleaned_of(text_threshold, attr_value_threshold)).alias("cleaned"))


def dedup_elements(trees: DataFrame, key: str = "page_id") -> DataFrame:
    """First element of each (tag, class, text) in a page: (key, nid, tag, cls)."""
    element = f"named_struct('kind', {_KIND.format('n.nid')}, 'nid', n.nid)"
    kinds = f"array_sort(transform(filter(nodes, n -> n.nid > 0 AND n.cls <> ''), n -> {_let('words', text_of(), element)}))"
    first = _let("kinds", kinds, "filter(kinds, (k, i) -> i = 0 OR get(kinds, i - 1).kind <> k.kind)")
    return trees.select(
        key, F.expr(f"inline(transform({first}, k -> named_struct('nid', k.nid, 'tag', k.kind.tag, 'cls', k.kind.cls)))")
    )


# --------------------------------------------------------------- chunks

def html_chunks(
    pages: DataFrame, max_tokens: int = 100_000, key: str = "page_id", html: str = "html"
) -> DataFrame:
    """Markup in pieces of at most ``max_tokens`` (one token per four characters).

    (key, chunk_no, chunk); the chunks joined are the page, and a page within the limit is one chunk.
    Cuts lie between the pieces the parser reads, so none is inside a tag, comment or script; only
    text longer than the limit is cut by characters.
    """
    from tabledoc.operators.text_ops import pack_pieces

    return pack_pieces(pages, key, html, max_tokens * 4)
