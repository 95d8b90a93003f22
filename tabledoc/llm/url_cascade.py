"""URL filters by a cascade of Bloom filters.

The rules' keys (host and path prefix) are tested against all keys that the corpus's URLs could
match: every suffix of a host, with every path prefix, of the sizes that rules have.  The first
filter holds the listed keys; the second holds the unlisted keys of the corpus that the first
lets through; the third the listed keys that the second holds by mistake, and so on, until a level
makes no mistake.  For keys of this corpus membership then is exact, and judging a URL needs no join.
The filters' size follows the listed keys (a few bytes each), not the corpus: the first level's
false positives are kept at about as many as the listed keys.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabledoc.llm.bloom import Bloom, bits_for, build, key_hashes
from tabledoc.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A level beyond this means that two keys have both hashes in common (2^-128 a pair).
MOST_LEVELS = 40


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.substring(url, at + 3, F.length(url))
    none = F.lit("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(at > 0, host).otherwise(none), F.when(at > 0, path).otherwise(none)


def candidate_keys(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Keys of all rules that could fit: host suffixes and path prefixes of the sizes rules have."""
    shapes = sorted({(h.count(".") + 1, len(p)) for _, h, p in rules})
    labels = F.size(F.split(host, r"\."))
    keys = [
        F.when(
            (labels >= n) & (F.length(path) >= size) & (host != ""),
            F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, size)),
        )
        for n, size in shapes
    ]
    return F.array_compact(F.array(*keys)) if keys else F.array().cast("array<string>")


class Cascade:
    """Exact membership of listed keys, for keys of the universe it was built over."""

    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """A key is what the last level that holds it encodes: listed at odd levels, unlisted at even ones."""
        listed, going = np.zeros(len(h1), bool), np.ones(len(h1), bool)
        for n, level in enumerate(self.levels):
            going &= level.holds(h1, h2)
            listed[going] = n % 2 == 0
        return listed


def _passed(level: Bloom, keys: DataFrame) -> DataFrame:
    @F.arrow_udf("boolean")
    def holds(h1: pa.Array, h2: pa.Array) -> pa.Array:
        return pa.array(level.holds(h1.to_numpy(zero_copy_only=False), h2.to_numpy(zero_copy_only=False)))

    return keys.where(holds("h1", "h2"))


def build_cascade(universe: DataFrame, listed: DataFrame) -> Cascade:
    """A cascade from the corpus's ``key`` column and the listed ``key`` column (nulls are no keys)."""
    listed = listed.where("key is not null").select("key").distinct()
    h1, h2 = key_hashes(F.col("key"))
    own = listed.select("key", F.lit(True).alias("listed"))
    every = universe.where("key is not null").select("key").distinct().join(own, "key", "full_outer")
    hashed = materialise(every.select(h1.alias("h1"), h2.alias("h2"), F.coalesce("listed", F.lit(False)).alias("listed")), "universe")
    inside, outside = hashed.where("listed"), hashed.where(~F.col("listed"))
    n, others = inside.count(), outside.count()
    levels: list[Bloom] = []
    bits_per_key = 1.5 * np.log2(max(2.0, others / max(n, 1))) + 4  # about n keys get past level 1
    while n:
        if len(levels) >= MOST_LEVELS:
            raise ValueError("two keys share both hashes")
        level = build(inside, bits_for(n, bits_per_key), max(1, round(bits_per_key * 0.69)), 7 * len(levels) % 40)
        levels.append(level)
        past = materialise(_passed(level, outside), "past")
        n, inside, outside, bits_per_key = past.count(), past, inside, 4.0
    return Cascade(levels)


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]], url: str = "url", default: str = "allow"
) -> DataFrame:
    """Adds ``host, path, rule, verdict`` to every row.

    ``rules`` are (``allow`` or ``block``, host, path).  A rule fits its host and all subdomains if the
    URL's path starts with the rule's; the longest host-and-path wins, block before allow of one key.
    ``rule`` is that text or null; without a rule the verdict is ``default`` (not on any list).
    Null, empty and malformed URLs have an empty host and path and no rule.  Columns of the input with
    these names are replaced.
    """
    added = ("host", "path", "rule", "verdict")
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url))
    kept = [c for c in pages.columns if c not in added]
    rows = pages.select(*[F.col(f"`{c}`") for c in kept], host.alias("host"), path.alias("path"))
    keyed = rows.withColumn("_keys", candidate_keys(F.col("host"), F.col("path"), rules))
    universe = keyed.select(F.explode("_keys").alias("key"))
    block = [(h + p,) for verdict, h, p in rules if verdict == "block"]
    listed = [(h + p,) for _, h, p in rules]
    any_rule = build_cascade(universe, spark.createDataFrame(listed, "key string"))
    blocked = build_cascade(universe, spark.createDataFrame(block, "key string"))

    def member(cascade: Cascade):
        @F.arrow_udf("array<boolean>")
        def holds(h1: pa.Array, h2: pa.Array) -> pa.Array:
            a, b = h1.flatten().to_numpy(zero_copy_only=False), h2.flatten().to_numpy(zero_copy_only=False)
            size = np.concatenate(([0], np.cumsum(h1.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
            return pa.ListArray.from_arrays(pa.array(size.astype(np.int32)), pa.array(cascade.holds(a, b)))

        first = F.transform("_keys", lambda k: key_hashes(k)[0])
        second = F.transform("_keys", lambda k: key_hashes(k)[1])
        return holds(first, second)

    tested = keyed.withColumns({"_listed": member(any_rule), "_blocked": member(blocked)})
    fits = F.filter(F.arrays_zip("_keys", "_listed", "_blocked"), lambda x: x["_listed"])
    best = F.array_max(F.transform(fits, lambda x: F.struct(F.length(x["_keys"]).alias("size"), x["_blocked"].alias("block"), x["_keys"].alias("key"))))
    return tested.withColumn("_best", best).select(
        *[F.col(f"`{c}`") for c in kept], "host", "path", F.col("_best.key").alias("rule"),
        F.when(F.col("_best").isNull(), default).when(F.col("_best.block"), "block").otherwise("allow").alias("verdict"),
    )
