"""Connected components by alternating large and small stars (public algorithm of Kiveris et al., 2014)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabledoc.session import materialise


def forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Of edges between 0..n-1, a spanning forest: as many groups, at most n - 1 edges."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (smallest id reached) of every id in the edges ``a, b`` (long).

    Every round writes its edges to the shared folder, which ends the lineage.  A group's edges are
    never collected: its minimum is a partial aggregate, and the join that hands it out is one that
    Spark can split where an id has very many edges.  No edges give no rows.
    """
    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))

    now = materialise(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u != v").distinct()
        minimum = least(down)
        small = down.join(minimum, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(minimum.select("u", F.col("m").alias("v"))).where("u != v")
        now = materialise(small.distinct(), "edges")
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            break
        seen = state
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("id"), "component")).distinct()
