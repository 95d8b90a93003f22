"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Vectors are scaled to length 1 and quantised to int8 with a scale of their own; the length e of the
quantisation error is kept.  For two vectors the true cosine differs from the quantised product by at
most e_u |v'| + |u'| e_v + e_u e_v, so a pair whose product plus bound is below the threshold cannot be
a link and is dropped; the others are computed again in double precision.

Equal vectors become one class first, so copies are never compared.  Classes of a label are dealt into
blocks; a task gets two blocks and returns, not pairs, but the number of links of each class and a
spanning forest of the links, which is at most one row per class of the tile.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabledoc.llm.components import components, forest
from tabledoc.llm.vectors import matrix, usable, width
from tabledoc.session import materialise

#: Classes of a block.
BLOCK = 2048


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of unit vectors: int8 codes, their scales, the lengths of the errors and of the quantised vectors."""
    scale = np.abs(x).max(1, initial=0) / 127
    scale[scale == 0] = 1
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    return codes, scale, np.linalg.norm(x - back, axis=1), np.linalg.norm(back, axis=1)


def possible(a: tuple, b: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a row of ``a`` and one of ``b`` (as from ``quantise``) whose cosine may reach the threshold."""
    # float32 holds sums of int8 products exactly up to 2^24, float64 beyond
    kind = np.float32 if a[0].shape[1] * 127 * 127 < 2**24 else np.float64
    product = (a[0].astype(kind) @ b[0].astype(kind).T).astype(np.float64)
    product *= a[1][:, None] * b[1][None, :]
    product += a[2][:, None] * b[3][None, :] + (a[3] + a[2])[:, None] * b[2][None, :]
    return np.nonzero(product >= threshold - 1e-9)  # the slack covers rounding in double precision


def tile_links(x: np.ndarray, y: np.ndarray | None, wx: np.ndarray, wy: np.ndarray, threshold: float) -> tuple:
    """Links between the rows of ``x`` and ``y`` (inside ``x`` if ``y`` is None).

    Gives the weights of linked rows for each row of x and of y, and a spanning forest of the links
    with rows of y numbered after those of x.
    """
    inside = y is None
    y, wy = (x, wx) if inside else (y, wy)
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    qx, qy = quantise(x / nx[:, None]), quantise(y / ny[:, None])
    first = 0 if inside else len(x)
    group = np.arange(first + len(y))
    of_x, of_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    edges: list[tuple[int, int]] = []
    for at in range(0, len(x), 512):
        i, j = possible(tuple(q[at : at + 512] for q in qx), qy, threshold)
        i = i + at
        if inside:
            i, j = i[i < j], j[i < j]
        for part in range(0, len(i), 1 << 17):
            a, b = i[part : part + (1 << 17)], j[part : part + (1 << 17)]
            link = np.einsum("ij,ij->i", x[a], y[b]) / (nx[a] * ny[b]) >= threshold
            a, b = a[link], b[link]
            of_x += np.bincount(a, wy[b], len(x)).astype(np.int64)
            of_y += np.bincount(b, wx[a], len(y)).astype(np.int64)
            new = group[a] != group[b + first]
            if new.any():
                edges += forest(a[new], b[new] + first, len(group))
                group = _groups(edges, len(group))
    edges = [edges[n] for n in _kept(edges, len(group))]
    return of_x, of_y, edges


def _kept(edges: list[tuple[int, int]], n: int) -> list[int]:
    """Which of the edges a spanning forest needs."""
    if not edges:
        return []
    kept = set(forest(np.array([e[0] for e in edges]), np.array([e[1] for e in edges]), n))
    return [i for i, e in enumerate(edges) if e in kept]


def _groups(edges: list[tuple[int, int]], n: int) -> np.ndarray:
    """Group number of each of n nodes."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    return np.array([root(i) for i in range(n)])


def near_duplicates(
    data: DataFrame, threshold: float = 0.98, key: str = "vec_id", vector: str = "embedding",
    group: str = "label", block: int = BLOCK,
) -> DataFrame:
    """One row per row: ``vec_id, n_links, component_id, kept``.

    Rows link when their groups are equal and not null and the cosine in double precision is at least
    ``threshold`` (positive).  Vectors that are null, zero or hold null or non-finite components, and rows
    without group or id, link with nothing.  A repeated row is another vector.  ``n_links`` counts the
    linked rows, ``component_id`` is the smallest id reached, ``kept`` whether that is the row itself (null
    without id).  Vectors of unequal length count as padded with zeros.  An empty table gives no rows.
    """
    good = F.col(key).isNotNull() & F.col(group).isNotNull() & usable(F.col(vector)) & F.exists(vector, lambda x: x != 0)
    rows = materialise(
        data.select(F.col(key).alias("vec_id"), F.when(good, F.col(group)).alias("g"), F.when(good, F.col(vector)).alias("v")), "vectors"
    )
    linking = rows.where("v is not null")
    classes = materialise(linking.groupBy("g", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes")
    dim = width(classes, "v")
    sizes = classes.groupBy("g").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = classes.join(sizes, "g").withColumn("own", own)
    other = F.explode(F.expr("sequence(0, blocks - 1)")).alias("other")
    tiles = dealt.select("g", "v", "rep", "copies", "own", other).select(
        "g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "copies", "v"
    )

    def solve(t: pd.DataFrame) -> pd.DataFrame:
        i, j = int(t["i"].iloc[0]), int(t["j"].iloc[0])
        t = t.sort_values("rep")
        a, b = (t, None) if i == j else (t[t["own"] == i], t[t["own"] == j])
        whole = lambda f: matrix(pa.array(f["v"].tolist(), pa.list_(pa.float64())), dim)
        copies = lambda f: f["copies"].to_numpy()
        ids = np.concatenate([a["rep"].to_numpy()] + ([] if b is None else [b["rep"].to_numpy()]))
        if not len(a) or (b is not None and not len(b)):
            return pd.DataFrame({"rep": [], "links": [], "to": []})
        of_a, of_b, edges = tile_links(whole(a), None if b is None else whole(b), copies(a), None if b is None else copies(b), threshold)
        links = of_a + of_b if b is None else np.concatenate((of_a, of_b))
        some = np.flatnonzero(links)
        return pd.DataFrame(
            {
                "rep": np.concatenate((ids[some], ids[[e[0] for e in edges]] if edges else ids[:0])),
                "links": np.concatenate((links[some], np.zeros(len(edges), np.int64))),
                "to": pd.array([None] * len(some) + [int(ids[e[1]]) for e in edges], "Int64"),
            }
        )

    found = materialise(tiles.groupBy("g", "i", "j").applyInPandas(solve, "rep long, links long, to long"), "tiles")
    links = found.where("to is null").groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.where("to is not null").select(F.col("rep").alias("a"), F.col("to").alias("b")))
    known = (
        classes.join(links, "rep", "left")
        .join(joined.withColumnRenamed("id", "rep"), "rep", "left")
        .select("g", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    )
    out = rows.join(known, ["g", "v"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
