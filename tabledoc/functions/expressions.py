"""Column expressions: ids, normalising, keys, slugs, URL parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_id(prefix: str, *parts: Column | str) -> Column:
    """``prefix`` and the first eight hex digits of the md5 of the joined parts."""
    return F.concat(F.lit(prefix), F.left(F.md5(F.concat(*parts)), F.lit(8)))


def page_id(url: str = "url") -> Column:
    return short_id("page_", F.col(url))


def norm_string(value: Column | str) -> Column:
    """Without a trailing "era", white space collapsed, lower case; NULL is empty."""
    col = F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(""))
    bare = F.regexp_replace(col, r"(?iU)\s*era\s*$", "")
    return F.lower(F.trim(F.regexp_replace(bare, r"(?U)\s+", " ")))


def slug(value: Column | str) -> Column:
    """File name of a title: word characters joined by underscores, lower case."""
    bare = F.regexp_replace(value, r"(?U)[^\w\s-]", "")
    return F.lower(F.regexp_replace(bare, r"(?U)[-\s]+", "_"))


def url_path(url: Column) -> Column:
    """Decoded path of a URL; spaces and other illegal characters are accepted."""
    cut = F.regexp_replace(url, r"[?#].*$", "")
    path = F.regexp_replace(cut, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/]*)?", "")
    bare = F.regexp_replace(path, r";[^/]*$", "")
    # a plus sign is itself in a path, but a space to url_decode
    return F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def verify_contains(output: Column | str, needle: str) -> Column:
    return F.coalesce(F.contains(F.col(output) if isinstance(output, str) else output, F.lit(needle)), F.lit(False))
