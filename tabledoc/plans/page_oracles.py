"""DuckDB texts for the page queries.

The given pages share one layout (navigation list, ad, article with one heading and
paragraphs of which some hold an unclosed ``<b>``, footer), so their trees can be written
down with string functions, independently of the parser.
"""

from __future__ import annotations


def decoded(value: str) -> str:
    """SQL: the entities that occur in the pages, decoded."""
    # a heading may end inside an entity, which is then read without its semicolon
    for entity, char in (("&lt", "<"), ("&gt", ">"), ("&quot", '"'), ("&#x27", "''"), ("&#39", "''"),
                         ("&copy", "©"), ("&middot", "·"), ("&nbsp", " "), ("&amp", "&")):
        value = f"regexp_replace({value}, '{entity};?', '{char}', 'g')"
    return value


def stripped(value: str) -> str:
    return rf"regexp_replace({value}, '^\s+|\s+$', '', 'g')"


def _escaped(value: str) -> str:
    return f"replace(replace(replace({value}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def cut(value: str) -> str:
    plain = decoded(value)
    return _escaped(f"CASE WHEN length({stripped(plain)}) > 100 THEN left({stripped(plain)}, 100) || '...' ELSE {plain} END")


H1 = "regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')"
OUTLINE = f"'# ' || {stripped(decoded(H1))} || chr(10) || '   XPath: //body/article/h1'"

PARTS = f"""parts AS (SELECT page_id, html, {H1} AS h1,
        string_split(regexp_extract(html, '</h1>(.*)</article>', 1, 's'), '<p>')[2:] AS ps,
        regexp_extract_all(html, '<li><a href="([^"]*)">', 1) AS hrefs,
        regexp_extract_all(html, '<li><a href="[^"]*">(.*?)</a></li>', 1, 's') AS links,
        regexp_extract(html, '<div class="ad">(.*?)</div>', 1, 's') AS ad,
        regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS title,
        regexp_extract(html, '<script>(.*?)</script>', 1, 's') AS script,
        regexp_extract(html, '<html lang="([^"]*)">', 1) AS lang,
        regexp_extract(html, '<footer>(.*?)</footer>', 1, 's') AS foot FROM pages),
    p AS (SELECT page_id, k, starts_with(raw, '<b>') AS b, replace(replace(replace(raw, '<b>', ''), '<br>', ''), '</p>', '') AS words,
        coalesce(sum(CASE WHEN starts_with(raw, '<b>') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bs
        FROM (SELECT page_id, generate_subscripts(ps, 1) AS k, unnest(ps) AS raw FROM parts)),
    li AS (SELECT page_id, generate_subscripts(links, 1) AS i, unnest(links) AS link, unnest(hrefs) AS href FROM parts),
    size AS (SELECT parts.page_id, len(links) AS n, len(ps) AS np, 12 + 2 * len(links) + len(ps) + 2 * len(list_filter(ps, lambda x: starts_with(x, '<b>'))) AS foot_nid FROM parts)"""

# one row per element: (page_id, nid, parent, depth, tag, cls, attrs, pos, last, xpath, css)
ELEMENTS = f"""WITH {PARTS}, e AS (
    SELECT page_id, 0 AS nid, -1 AS parent, 0 AS depth, 'html' AS tag, NULL AS cls, '{{"lang":"' || lang || '"}}' AS attrs, 1 AS pos, foot_nid AS last, '/' AS xpath, '' AS css FROM parts JOIN size USING (page_id)
    UNION ALL SELECT page_id, 1, 0, 1, 'head', NULL, '{{}}', 1, 5, '//head', 'head' FROM parts
    UNION ALL SELECT page_id, 2, 1, 2, 'meta', NULL, '{{"charset":"utf-8"}}', 1, 2, '//head/meta', 'head > meta' FROM parts
    UNION ALL SELECT page_id, n, 1, 2, t, NULL, '{{}}', 1, n, '//head/' || t, 'head > ' || t FROM (SELECT page_id, unnest([3, 4, 5]) AS n, unnest(['title', 'style', 'script']) AS t FROM parts)
    UNION ALL SELECT page_id, 6, 0, 1, 'body', NULL, '{{}}', 1, foot_nid, '//body', 'body' FROM size
    UNION ALL SELECT page_id, 7, 6, 2, 'nav', NULL, '{{}}', 1, 8 + 2 * n, '//body/nav', 'body > nav' FROM size
    UNION ALL SELECT page_id, 8, 7, 3, 'ul', NULL, '{{}}', 1, 8 + 2 * n, '//body/nav/ul', 'body > nav > ul' FROM size
    UNION ALL SELECT page_id, 7 + 2 * i, 8, 4, 'li', NULL, '{{}}', i, 8 + 2 * i, '//body/nav/ul/li' || CASE WHEN n > 1 THEN '[' || i || ']' ELSE '' END,
        'body > nav > ul > li' || CASE WHEN n > 1 THEN ':nth-of-type(' || i || ')' ELSE '' END FROM li JOIN size USING (page_id)
    UNION ALL SELECT page_id, 8 + 2 * i, 7 + 2 * i, 5, 'a', NULL, '{{"href":"' || {decoded("href")} || '"}}', 1, 8 + 2 * i, '//body/nav/ul/li' || CASE WHEN n > 1 THEN '[' || i || ']' ELSE '' END || '/a',
        'body > nav > ul > li' || CASE WHEN n > 1 THEN ':nth-of-type(' || i || ')' ELSE '' END || ' > a' FROM li JOIN size USING (page_id)
    UNION ALL SELECT page_id, 9 + 2 * n, 6, 2, 'div', 'ad', '{{"class":"ad"}}', 1, 9 + 2 * n, '//body/div', 'body > div.ad' FROM size
    UNION ALL SELECT page_id, 10 + 2 * n, 6, 2, 'article', NULL, '{{}}', 1, foot_nid - 1, '//body/article', 'body > article' FROM size
    UNION ALL SELECT page_id, 11 + 2 * n, 10 + 2 * n, 3, 'h1', NULL, '{{}}', 1, 11 + 2 * n, '//body/article/h1', 'body > article > h1' FROM size
    UNION ALL SELECT page_id, 11 + 2 * n + k + 2 * bs, 10 + 2 * n, 3, 'p', NULL, '{{}}', k, 11 + 2 * n + k + 2 * bs + CASE WHEN b THEN 2 ELSE 0 END,
        '//body/article/p' || CASE WHEN np > 1 THEN '[' || k || ']' ELSE '' END, 'body > article > p' || CASE WHEN np > 1 THEN ':nth-of-type(' || k || ')' ELSE '' END FROM p JOIN size USING (page_id)
    UNION ALL SELECT page_id, 12 + 2 * n + k + 2 * bs, 11 + 2 * n + k + 2 * bs, 4, 'b', NULL, '{{}}', 1, 13 + 2 * n + k + 2 * bs,
        '//body/article/p' || CASE WHEN np > 1 THEN '[' || k || ']' ELSE '' END || '/b', 'body > article > p' || CASE WHEN np > 1 THEN ':nth-of-type(' || k || ')' ELSE '' END || ' > b' FROM p JOIN size USING (page_id) WHERE b
    UNION ALL SELECT page_id, 13 + 2 * n + k + 2 * bs, 12 + 2 * n + k + 2 * bs, 5, 'br', NULL, '{{}}', 1, 13 + 2 * n + k + 2 * bs,
        '//body/article/p' || CASE WHEN np > 1 THEN '[' || k || ']' ELSE '' END || '/b/br', 'body > article > p' || CASE WHEN np > 1 THEN ':nth-of-type(' || k || ')' ELSE '' END || ' > b > br' FROM p JOIN size USING (page_id) WHERE b
    UNION ALL SELECT page_id, foot_nid, 6, 2, 'footer', NULL, '{{}}', 1, foot_nid, '//body/footer', 'body > footer' FROM size)
"""

# gaps and islands among siblings that are not skipped, over the written-down elements
RUNS = ELEMENTS + """, kin AS (SELECT e.page_id, e.nid, e.parent, e.tag, count(k.nid) AS kept FROM e
        LEFT JOIN e k ON k.page_id = e.page_id AND k.parent = e.nid AND k.tag NOT IN ('script', 'style', 'meta', 'link', 'noscript')
        WHERE e.tag NOT IN ('script', 'style', 'meta', 'link', 'noscript') GROUP BY ALL),
    steps AS (SELECT *, CASE WHEN lag(tag) OVER w IS DISTINCT FROM tag OR lag(kept) OVER w <> kept OR regexp_matches(tag, '^h[1-6]$') THEN 1 ELSE 0 END AS step
        FROM kin WINDOW w AS (PARTITION BY page_id, parent ORDER BY nid)),
    numbered AS (SELECT *, sum(step) OVER (PARTITION BY page_id, parent ORDER BY nid) AS run FROM steps)
    SELECT page_id, CAST(nid AS INT) AS nid, CAST(parent AS INT) AS parent, tag, CAST(run AS INT) AS run_no,
        CAST(count(*) OVER (PARTITION BY page_id, parent, run) AS INT) AS run_len,
        CAST(row_number() OVER (PARTITION BY page_id, parent, run ORDER BY nid) AS INT) AS run_pos FROM numbered"""

_NL = "chr(10)"
SKELETON_CTE = f"""{PARTS},
    runs AS (SELECT *, sum(step) OVER (PARTITION BY page_id ORDER BY k) AS run FROM
        (SELECT *, CASE WHEN lag(b) OVER (PARTITION BY page_id ORDER BY k) IS DISTINCT FROM b THEN 1 ELSE 0 END AS step FROM p)),
    g AS (SELECT *, count(*) OVER (PARTITION BY page_id, run) AS n_run, row_number() OVER (PARTITION BY page_id, run ORDER BY k) AS nth,
        max(k) OVER (PARTITION BY page_id) AS last_k, max(k) OVER (PARTITION BY page_id, run) AS run_end FROM runs),
    pl AS (SELECT page_id, string_agg(CASE
            WHEN n_run >= 3 THEN '      ' || CASE WHEN run_end = last_k THEN '└── ' ELSE '├── ' END || 'p' || CASE WHEN b THEN ' [1 b]' ELSE '' END || ' × ' || n_run
            ELSE '      ' || CASE WHEN k = last_k THEN '└── ' ELSE '├── ' END || 'p' || CASE WHEN b THEN ' (1 children)' || {_NL}
                || '        └── b (1 children)' || {_NL} || '          └── br' ELSE '' END END, {_NL} ORDER BY k) AS lines
        FROM g WHERE n_run < 3 OR nth = 1 GROUP BY page_id),
    ll AS (SELECT page_id, CASE WHEN n >= 3 THEN {_NL} || '        └── li [1 a] × ' || n WHEN n = 2 THEN {_NL} || '        ├── li (1 children)' || {_NL} || '          └── a'
            || {_NL} || '        └── li (1 children)' || {_NL} || '          └── a' WHEN n = 1 THEN {_NL} || '        └── li (1 children)' || {_NL} || '          └── a' ELSE '' END AS lines FROM size),
    skeleton AS (SELECT parts.page_id, 'html (2 children)' || {_NL} || '  ├── head (1 children)' || {_NL} || '    └── title' || {_NL} || '  └── body (4 children)' || {_NL}
        || '    ├── nav (1 children)' || {_NL} || '      └── ul' || CASE WHEN n > 0 THEN ' (' || n || ' children)' ELSE '' END || ll.lines || {_NL} || '    ├── div.ad' || {_NL}
        || '    ├── article (' || (np + 1) || ' children)' || {_NL} || '      ' || CASE WHEN np = 0 THEN '└── ' ELSE '├── ' END || 'h1 → "' || left({stripped(decoded("h1"))}, 80) || '"'
        || coalesce({_NL} || pl.lines, '') || {_NL} || '    └── footer' AS skeleton
        FROM parts JOIN size USING (page_id) JOIN ll USING (page_id) LEFT JOIN pl USING (page_id))"""

CLEAN_CTE = f"""cl AS (SELECT page_id, string_agg('<li><a>' || {cut("link")} || '</a></li>', '' ORDER BY i) AS s FROM li GROUP BY page_id),
    cp AS (SELECT page_id, string_agg('<p>' || CASE WHEN b THEN '<b>' || {cut("words")} || '<br></b>' ELSE {cut("words")} END || '</p>', '' ORDER BY k) AS s FROM p GROUP BY page_id),
    cleaned AS (SELECT parts.page_id, '<html lang="' || lang || '"><body><nav><ul>' || coalesce(cl.s, '') || '</ul></nav><div class="ad">' || {cut("ad")} || '</div><article><h1>' || {cut("h1")}
        || '</h1>' || coalesce(cp.s, '') || '</article><footer>' || {cut("foot")} || '</footer></body></html>' AS cleaned FROM parts LEFT JOIN cl USING (page_id) LEFT JOIN cp USING (page_id))"""


def words(value: str) -> str:
    return rf"regexp_replace({decoded(value)}, '\s+', ' ', 'g')"


MARKDOWN_CTE = f"""ml AS (SELECT page_id, string_agg('  * [' || {words("link")} || '](' || {decoded("href")} || ')', {_NL} ORDER BY i) AS s FROM li GROUP BY page_id),
    mp AS (SELECT page_id, string_agg({_NL} || {_NL} || CASE WHEN b THEN '**' || {words("words")} || '  ' || {_NL} || '**' ELSE trim({words("words")}) END, '' ORDER BY k) AS s FROM p GROUP BY page_id),
    markdown AS (SELECT parts.page_id, coalesce(ml.s || {_NL} || {_NL}, '') || trim({words("ad")}) || {_NL} || {_NL} || '# ' || trim({words("h1")})
        || coalesce(mp.s, '') || {_NL} || {_NL} || trim({words("foot")}) AS markdown FROM parts LEFT JOIN ml USING (page_id) LEFT JOIN mp USING (page_id))"""

VIEW = f"""WITH {PARTS}, {MARKDOWN_CTE}
    SELECT page_id, CAST(length(markdown) AS INT) AS size, 'Markdown view of ' || url || {_NL} || 'Size: ' || length(markdown) || ' characters' || {_NL} || {_NL} || 'Headings structure:' || {_NL}
        || '# ' || trim({words("h1")}) || ' (line ' || (n + CASE WHEN n > 0 THEN 1 ELSE 0 END + 3) || ')' || {_NL} || {_NL} || 'Full markdown content:' || {_NL}
        || CASE WHEN length(markdown) > 10000 THEN left(markdown, 10000) || {_NL} || {_NL} || '...(truncated due to max length)...' ELSE markdown END AS view
    FROM markdown JOIN parts USING (page_id) JOIN size USING (page_id) JOIN pages USING (page_id)"""

CANDIDATES = f"""WITH {PARTS}, own AS (
    SELECT page_id, '//body/div[@class=''ad'']' AS xpath, {decoded("ad")} AS own, 'ad' AS label FROM parts
    UNION ALL SELECT page_id, '//head/title', {decoded("title")}, '' FROM parts
    UNION ALL SELECT page_id, '//head/script', script, '' FROM parts
    UNION ALL SELECT page_id, '//body/article/h1', {decoded("h1")}, '' FROM parts
    UNION ALL SELECT page_id, '//body/footer', {decoded("foot")}, '' FROM parts
    UNION ALL SELECT page_id, '//body/nav/ul/li/a', {decoded("link")}, '' FROM li
    UNION ALL SELECT page_id, '//body/article/p' || CASE WHEN b THEN '/b' ELSE '' END, {decoded("words")}, '' FROM p)
    SELECT xpath, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT page_id) AS BIGINT) AS n_pages, min(own) AS sample
    FROM own WHERE regexp_matches(own, '(?i)\\bad\\b|released under|license') OR regexp_matches(label, '(?i)\\bad\\b|released under|license') GROUP BY xpath"""
