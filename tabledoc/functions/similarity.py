"""Fuzzy text comparison.

The longest-matching-block ratio has no built-in, so it is the one scalar that crosses to
Python, in Arrow batches and only for pairs whose normalised texts differ.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabledoc.functions.expressions import base_name, norm_string, url_path


@F.pandas_udf(T.DoubleType())
def _block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2M/T of matching blocks; NULL pairs stay NULL."""
    known: dict[tuple[str, str], float] = {}

    def ratio(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        if (x, y) not in known:
            known[(x, y)] = SequenceMatcher(None, x, y).ratio()
        return known[(x, y)]

    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def _ratio_of(a: Column, b: Column) -> Column:
    """Ratio of two normalised texts; equal, and empty against non-empty, need no Python."""
    open_pair = (a != b) & (a != "") & (b != "")
    asked = _block_ratio(F.when(open_pair, a), F.when(open_pair, b))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(asked)


Pairs = dict[str, tuple[Column | str, Column | str]]


def _col(value: Column | str) -> Column:
    return F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(""))


def add_similarity(df: DataFrame, pairs: Pairs) -> DataFrame:
    """Add a similarity in [0, 1] per pair of texts; both empty is 1.

    Texts that differ are normalised once, in a projection of their own, and compared in
    the next; equal ones are done without a regular expression.
    """
    raw = {f"_{o}{i}": _col(v) for o, pair in pairs.items() for i, v in enumerate(pair)}
    differ = {o: F.col(f"_{o}0") != F.col(f"_{o}1") for o in pairs}
    normal = {f"{c}n": F.when(differ[c[1:-1]], norm_string(c)) for c in raw}
    ratios = {
        o: F.when(differ[o], _ratio_of(F.col(f"_{o}0n"), F.col(f"_{o}1n"))).otherwise(1.0) for o in pairs
    }
    return df.withColumns(raw).withColumns(normal).withColumns(ratios).drop(*raw, *normal)


def add_url_similarity(df: DataFrame, pairs: Pairs) -> DataFrame:
    """Add a similarity per pair of URLs: 1 for the same decoded file name, else that of the
    decoded paths; both empty is 1, one empty 0."""
    raw = {f"_{o}{i}": _col(v) for o, pair in pairs.items() for i, v in enumerate(pair)}
    df = df.withColumns(raw).withColumns({f"{c}p": url_path(F.col(c)) for c in raw})

    def verdict(o: str) -> Column:
        a, b = F.col(f"_{o}0"), F.col(f"_{o}1")
        same = base_name(F.col(f"_{o}0p")) == base_name(F.col(f"_{o}1p"))
        return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).when(same, 1.0)

    df = df.withColumns({f"_{o}v": verdict(o) for o in pairs})
    # only undecided pairs are normalised and compared
    texts = {f"{c}n": F.when(F.col(f"{c[:-1]}v").isNull(), norm_string(F.col(f"{c}p"))) for c in raw}
    df = df.withColumns(texts)
    out = {o: F.coalesce(f"_{o}v", _ratio_of(F.col(f"_{o}0n"), F.col(f"_{o}1n"))) for o in pairs}
    used = [*raw, *[f"{c}p" for c in raw], *texts, *[f"_{o}v" for o in pairs]]
    return df.withColumns(out).drop(*used)


def add_decided(df: DataFrame, out: str, texts: Pairs, urls: Pairs) -> DataFrame:
    """Add the array ``out`` of one (decided, a, b) for each pair, the URLs first.

    ``decided`` is the similarity where no comparison is needed; else it is null and ``a`` and ``b`` are the normalised texts
    to compare.  Each step has a projection of its own, so that a text is normalised once.
    """
    pairs = urls | texts
    raw = {f"_{o}{i}": _col(v) for o, pair in pairs.items() for i, v in enumerate(pair)}
    df = df.withColumns(raw).withColumns({f"{c}p": url_path(F.col(c)) for c in raw if c[1:-1] in urls})
    same = {o: F.col(f"_{o}0") == F.col(f"_{o}1") for o in texts} | {
        o: (base_name(F.col(f"_{o}0p")) == base_name(F.col(f"_{o}1p"))) for o in urls
    }
    none = {o: (F.col(f"_{o}0") == "", F.col(f"_{o}1") == "") for o in urls}
    early = {o: F.when(same[o], 1.0) for o in texts} | {
        o: F.when(a & b, 1.0).when(a | b, 0.0).when(same[o], 1.0) for o, (a, b) in none.items()
    }
    df = df.withColumns({f"_{o}v": early[o] for o in pairs})
    side = lambda o, i: F.col(f"_{o}{i}p" if o in urls else f"_{o}{i}")
    df = df.withColumns({f"_{o}{i}n": F.when(F.col(f"_{o}v").isNull(), norm_string(side(o, i))) for o in pairs for i in (0, 1)})
    made = []
    for o in pairs:
        a, b = F.col(f"_{o}0n"), F.col(f"_{o}1n")
        late = F.when(F.col(f"_{o}v").isNotNull(), F.col(f"_{o}v")).when(a == b, 1.0).when((a == "") | (b == ""), 0.0)
        made.append(F.struct(late.alias("decided"), a.alias("a"), b.alias("b")))
    used = [*raw, *[f"{c}p" for c in raw if c[1:-1] in urls], *[f"_{o}v" for o in pairs], *[f"{c}n" for c in raw]]
    return df.withColumn(out, F.array(*made)).drop(*used)


def compared(pairs: DataFrame) -> DataFrame:
    """The ratio of every distinct pair of texts that is not decided: (a, b, ratio); only these go to Python, once each."""
    return pairs.select("a", "b").distinct().withColumn("ratio", _block_ratio("a", "b"))


def register(spark: SparkSession) -> None:
    """Make ``text_ratio(a, b)`` available to SQL text."""
    spark.udf.register("text_ratio", _block_ratio)
