"""Queries over ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabledoc.functions.expressions import page_id, short_id
from tabledoc.operators import html_ops as ops
from tabledoc.operators.html_tree import elements, parse_pages
from tabledoc.plans import page_oracles as po
from tabledoc.plans.registry import query
from tabledoc.session import load_spread
from tabledoc.sources.files import decode_bytes, ingest_images, load_pages


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_spread(spark, sf_dir, "pages", "page_id")


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_pages(_pages(spark, sf_dir))


@query(
    "html_elements",
    po.ELEMENTS + "SELECT page_id, nid, parent, depth, tag, CAST(NULL AS VARCHAR) AS id, cls, attrs, CAST(pos AS INT) AS pos, CAST(last AS INT) AS last FROM e",
)
def html_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = elements(_trees(spark, sf_dir))
    return rows.select(
        "page_id", "nid", "parent", "depth", "tag", "id", "cls", F.to_json("attrs").alias("attrs"), "pos", "last"
    )


@query(
    "html_tag_counts",
    """SELECT page_id, tag, CAST(count(*) AS BIGINT) AS n FROM
       (SELECT page_id, lower(unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM pages)
       GROUP BY page_id, tag""",
)
def html_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements(_trees(spark, sf_dir)).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query(
    "html_headings",
    f"""SELECT page_id, 1 AS ord, 1 AS level, {po.stripped(po.decoded(po.H1))} AS text,
              '//body/article/h1' AS xpath, 'body > article > h1' AS css FROM pages""",
)
def html_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.page_headings(_trees(spark, sf_dir))


@query(
    "html_outline",
    f"""SELECT page_id, {po.OUTLINE} AS outline FROM pages""",
)
def html_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.html_outline(_trees(spark, sf_dir))


@query("dom_skeleton", f"WITH {po.SKELETON_CTE} SELECT page_id, skeleton FROM skeleton")
def dom_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.dom_skeleton(_trees(spark, sf_dir), ops.SKELETON_DEPTH, heading_chars=ops.HEADING_TEXT_CHARS)


@query("sibling_runs", po.RUNS)
def sibling_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.sibling_runs(_trees(spark, sf_dir))


@query("element_xpath", po.ELEMENTS + "SELECT page_id, nid, tag, xpath FROM e")
def element_xpath(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.element_paths(_trees(spark, sf_dir)).select("page_id", "nid", "tag", "xpath")


@query("element_css", po.ELEMENTS + "SELECT page_id, nid, tag, css FROM e")
def element_css(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.element_paths(_trees(spark, sf_dir)).select("page_id", "nid", "tag", "css")


@query(
    "xpath_extract",
    f"""SELECT page_id, i - 1 AS i, {po.decoded("m")} AS value FROM
       (SELECT page_id, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">', 1), 1) AS i,
               unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS m FROM pages)""",
)
def xpath_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.xpath_extract(_trees(spark, sf_dir), "//nav/ul/li/a/@href")


@query(
    "xpath_extract_html",
    """SELECT page_id, i - 1 AS i, m AS value FROM
       (SELECT page_id, generate_subscripts(regexp_extract_all(html, '<li>.*?</li>', 0, 's'), 1) AS i,
               unnest(regexp_extract_all(html, '<li>.*?</li>', 0, 's')) AS m FROM pages)""",
)
def xpath_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.xpath_extract(_trees(spark, sf_dir), "//nav//li", "html")


_LIST_TEXT = po.decoded("m")


@query(
    "css_extract",
    f"""SELECT page_id, i - 1 AS i, {po.stripped(_LIST_TEXT)} AS value FROM
       (SELECT page_id, generate_subscripts(regexp_extract_all(html, '<li><a href="[^"]*">(.*?)</a></li>', 1, 's'), 1) AS i,
               unnest(regexp_extract_all(html, '<li><a href="[^"]*">(.*?)</a></li>', 1, 's')) AS m FROM pages)""",
)
def css_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.css_extract(_trees(spark, sf_dir), "nav > ul li > a[href]")


@query(
    "extraction_report",
    r"""SELECT page_id, 'Found 1 element(s) matching ''//div[@class="ad"]'':' || chr(10) || chr(10) || '[0] '
        || regexp_extract(html, '<div class="ad">.*?</div>', 0, 's') AS report FROM pages""",
)
def extraction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.extraction_report(_trees(spark, sf_dir), '//div[@class="ad"]', "outer_html")


@query(
    "extraction_report_links",
    # pages have between none and six such links
    f"""WITH {po.PARTS}, hit AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS k, {po.decoded("href")} AS href
            FROM li WHERE contains({po.decoded("href")}, 'en')),
        found AS (SELECT page_id, count(*) AS n, string_agg('[' || k || '] {{"href":"' || href || '"}}', chr(10) ORDER BY k) AS listed FROM hit GROUP BY page_id)
        SELECT page_id, CASE WHEN n IS NULL THEN 'No elements found matching XPath: //nav//a[contains(@href, "en")]'
            ELSE 'Found ' || n || ' element(s) matching ''//nav//a[contains(@href, "en")]'':' || chr(10) || chr(10) || listed END AS report
        FROM pages LEFT JOIN found USING (page_id)""",
)
def extraction_report_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.extraction_report(_trees(spark, sf_dir), '//nav//a[contains(@href, "en")]', "attrs")


@query(
    "xpath_extract_markdown",
    f"""WITH {po.PARTS} SELECT page_id, CAST(i - 1 AS INT) AS i, '[' || {po.words("link")} || '](' || {po.decoded("href")} || ')' AS value FROM li""",
)
def xpath_extract_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.xpath_extract(_trees(spark, sf_dir), "//li/a", "markdown")


@query(
    "element_text",
    f"""SELECT page_id, {po.stripped(po.decoded("regexp_extract(html, '<footer>(.*?)</footer>', 1, 's')"))} AS value FROM pages""",
)
def element_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.xpath_extract(_trees(spark, sf_dir), "//footer", "text").select("page_id", "value")


@query(
    "element_html",
    """SELECT page_id, regexp_extract(html, '<nav>.*?</nav>', 0, 's') AS value FROM pages""",
)
def element_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.element_values(_trees(spark, sf_dir), "html", tag="nav").select("page_id", "value")


@query("html_clean", f"WITH {po.PARTS}, {po.CLEAN_CTE} SELECT page_id, cleaned FROM cleaned")
def html_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.html_clean(_trees(spark, sf_dir))


def _repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its advertisement once more before and up to twice more after its place, each with a text behind it."""
    ad = F.regexp_extract("html", '(?s)<div class="ad">.*?</div>', 0)
    more = F.expr("repeat(concat(ad, 'again'), CAST(page_id % 3 AS int))")
    html = F.expr("replace(replace(html, '</nav>', concat('</nav>', ad, 'first')), '<article>', concat(more, '<article>'))")
    return _pages(spark, sf_dir).withColumn("ad", ad).withColumn("more", more).select("page_id", html.alias("html"))


@query(
    "html_clean_repeats",
    f"""WITH {po.PARTS}, {po.CLEAN_CTE}, ads AS (SELECT page_id, '<div class="ad">' || {po.cut("ad")} || '</div>' AS shown FROM parts)
        SELECT page_id, replace(replace(cleaned, shown, ''), '</nav>', '</nav>' || shown || 'first') AS cleaned FROM cleaned JOIN ads USING (page_id)""",
)
def html_clean_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the equal advertisements the first stays, the others go with the text behind them."""
    return ops.html_clean(parse_pages(_repeated(spark, sf_dir)))


@query(
    "dedup_elements",
    # all elements with a class are advertisements of one text, the first of which comes after the navigation
    f"""WITH {po.PARTS} SELECT page_id, CAST(9 + 2 * len(links) AS INT) AS nid, 'div' AS tag, 'ad' AS cls FROM parts""",
)
def dedup_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.dedup_elements(parse_pages(_repeated(spark, sf_dir)))


@query("html_markdown", f"WITH {po.PARTS}, {po.MARKDOWN_CTE} SELECT page_id, markdown FROM markdown")
def html_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.html_markdown(_trees(spark, sf_dir))


@query("markdown_view", po.VIEW)
def markdown_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = ops.html_markdown(_trees(spark, sf_dir), "page_id", "url")
    view = ops.markdown_view(pages, max_chars=ops.MARKDOWN_VIEW_CHARS, max_headings=ops.MARKDOWN_VIEW_HEADINGS)
    return view.select("page_id", "size", "view")


@query(
    "html_chunks",
    """SELECT page_id, html, length(html) > 400 AS cut, CAST(0 AS BIGINT) AS open_ends, true AS bounded FROM pages""",
)
def html_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages cut to 100 tokens and joined again; no chunk ends inside a tag."""
    chunks = ops.html_chunks(_pages(spark, sf_dir), max_tokens=100)
    last = lambda mark: F.length("chunk") - F.length(F.substring_index("chunk", mark, -1))
    return chunks.groupBy("page_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "chunk"))), lambda c: c["chunk"]), "").alias("html"),
        (F.count("*") > 1).alias("cut"),
        F.count_if(last("<") > last(">")).alias("open_ends"),
        F.bool_and(F.length("chunk") <= 400).alias("bounded"),
    )


@query("xpath_candidates", po.CANDIDATES)
def xpath_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.xpath_candidates(_trees(spark, sf_dir), r"\bad\b|released under|license")


@query(
    "page_load",
    f"""WITH {po.SKELETON_CTE} SELECT 'page_' || left(md5(url), 8) AS data_id, url, CAST(length(html) AS BIGINT) AS html_size,
               {po.OUTLINE} AS outline, skeleton FROM pages JOIN skeleton USING (page_id)""",
)
def page_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page entries with outline and skeleton, from one parse of the markup."""
    sized = load_pages(_pages(spark, sf_dir), "page_id").withColumn("html_size", F.col("html_size").cast("bigint"))
    record = ops.page_overview(
        parse_pages(sized), max_depth=ops.SKELETON_DEPTH, heading_chars=ops.HEADING_TEXT_CHARS,
        data_id="data_id", url="url", html_size="html_size",
    )
    return record.select("data_id", "url", "html_size", "outline", "skeleton")


@query(
    "page_structure",
    f"""WITH {po.SKELETON_CTE}, {po.CLEAN_CTE}
        SELECT page_id, 'page_' || left(md5(url), 8) AS data_id, {po.OUTLINE} AS outline, skeleton, cleaned
        FROM pages JOIN skeleton USING (page_id) JOIN cleaned USING (page_id)""",
)
def page_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id, outline, skeleton and cleaned markup of every page, from one parse."""
    trees = parse_pages(_pages(spark, sf_dir).withColumn("data_id", page_id("url")))
    return ops.page_overview(
        trees, max_depth=ops.SKELETON_DEPTH, heading_chars=ops.HEADING_TEXT_CHARS, data_id="data_id", cleaned=ops.cleaned_of()
    )


@query(
    "page_decode",
    r"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN html ELSE regexp_replace(html, '[^\x{00}-\x{FF}]', '?', 'g') END AS html FROM pages""",
)
def page_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow = F.regexp_replace("html", r"[^\x00-\xFF]", "?")
    stored = F.when(F.col("page_id") % 2 == 0, F.encode("html", "UTF-8")).otherwise(F.encode(narrow, "ISO-8859-1"))
    return _pages(spark, sf_dir).select("page_id", decode_bytes(stored).alias("html"))


@query(
    "short_ids",
    """SELECT page_id, 'page_' || left(md5(url), 8) AS data_id,
              'csv_query_' || left(md5('csv_1' || url), 8) AS query_id,
              'csv_' || left(md5(url || ':' || length(html) || ':0'), 8) AS file_id FROM pages""",
)
def short_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select(
        "page_id",
        page_id("url").alias("data_id"),
        short_id("csv_query_", F.lit("csv_1"), F.col("url")).alias("query_id"),
        short_id("csv_", F.col("url"), F.lit(":"), F.length("html").cast("string"), F.lit(":0")).alias("file_id"),
    )


_EXTENSIONS = "['jpg', 'jpeg', 'png', 'gif', 'webp', 'bmp', 'tiff2', 'txt']"


@query(
    "image_ingest",
    f"""SELECT path, CASE WHEN e IN ('jpg', 'jpeg') THEN 'image/jpeg' WHEN e IN ('png', 'gif', 'webp', 'bmp') THEN 'image/' || e END AS mime_type,
               CASE WHEN e NOT IN ('tiff2', 'txt') THEN octet_length(encode(html)) / 1024.0::DOUBLE END AS size_kb,
               CASE WHEN e NOT IN ('tiff2', 'txt') THEN base64(encode(html)) END AS base64_data,
               CASE WHEN e IN ('tiff2', 'txt') THEN 'Unsupported image type: .' || e || '. Supported: .jpg, .jpeg, .png, .gif, .webp, .bmp' END AS error
        FROM (SELECT *, '/img/' || page_id || '.' || e AS path FROM (SELECT *, {_EXTENSIONS}[page_id % 8 + 1] AS e FROM pages))""",
)
def image_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of the pages stand in for image files."""
    kinds = _EXTENSIONS.replace("[", "array(").replace("]", ")")
    files = _pages(spark, sf_dir).select(
        F.expr(f"concat('/img/', page_id, '.', {kinds}[CAST(page_id % 8 AS INT)])").alias("path"),
        F.encode("html", "UTF-8").alias("content"),
    )
    return ingest_images(files)
