"""Exact top-k search by inner product as a Voronoi kNN join.

Inner products are turned into distances: with all data vectors lifted by one component to equal
norm M, |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the nearest are those with the highest product.  Data and
queries go to the cell of their nearest pivot.  Summaries of the cells (the k smallest distances of
data to the pivot, the largest of queries) bound, for every cell of queries, the distance theta of
its k-th neighbour.  By the triangle inequality a data vector of cell j can be among the neighbours
of query cell i only if its distance to pivot j lies within theta_i + radius_i of the distance of the
pivots, so only such vectors are replicated to the cell.  Cells are dealt into parts of bounded size,
each pair of parts is solved by one matrix product, and the parts' lists are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabledoc.llm.vectors import matrix, usable, width
from tabledoc.session import materialise

#: Pivots; the driver and every task hold so many vectors.
PIVOTS = 24
#: Rows of a part, about; a pair of parts is solved in one task.
PART_ROWS = 8192


def _lift(x: np.ndarray, most: float) -> np.ndarray:
    """One more component that brings every vector's squared norm to ``most``."""
    return np.hstack([x, np.sqrt(np.maximum(0.0, most - (x * x).sum(1)))[:, None]])


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(0.0, square))


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products: by floating point where that is exact, else by Python's integers."""
    bound = (np.abs(q).max(initial=0) * np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if bound < 2**53:
        return (q @ x.T).astype(np.int64)
    as_int = np.vectorize(int, otypes=[object])
    return (as_int(q) @ as_int(x).T).astype(np.int64)


def search(
    data: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0,
    key: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, part_rows: int = PART_ROWS,
) -> DataFrame:
    """The ``k`` best of all other rows for every row whose id is divisible by ``every``.

    Every component x becomes floor(scale * x) in double precision; the score is the integer inner
    product, ties go to the smaller id.  Gives ``query_id, rank`` (from 1), ``vec_id, score``.  Vectors that
    are null or hold null or non-finite components take no part, nor do rows without id.  Shorter
    vectors count as padded with zeros.  Rows that share the query's id are not its candidates; a
    repeated row is a candidate as often as it stands there, a repeated query is answered once.
    Too few candidates give all there are; an empty table gives no rows.
    """
    spark = data.sparkSession
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    rows = materialise(
        data.where(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("vec_id"), whole.alias("v")),
        "vectors",
    )
    dim = width(rows, "v")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    most = rows.agg(F.max(square)).first()[0] or 0.0
    # pivots: a fixed number of rows, far apart by chance
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    if not chosen:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    centre = np.zeros((len(chosen), dim))
    for i, r in enumerate(chosen):
        centre[i, : len(r["v"])] = r["v"]
    centre = _lift(centre, most)
    P = len(centre)

    def assign(batches: Iterator[pa.RecordBatch], query: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dim)
            # a query's lifted component is 0: then products and distances order alike
            lifted = np.hstack([x, np.zeros((len(x), 1))]) if query else _lift(x, most)
            d = _distances(lifted, centre)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])],
                names=["vec_id", "v", "cell", "far"],
            )

    fields = "vec_id long, v array<double>, cell int, far double"
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id", "v"])
    placed = materialise(rows.mapInArrow(lambda b: assign(b, False), fields), "cells")
    queries = materialise(asked.mapInArrow(lambda b: assign(b, True), fields), "cells")

    # summaries: k (+1, as a query's own row does not count) smallest distances of each data cell
    near = Window.partitionBy("cell").orderBy("far")
    close = placed.select("cell", "far", "vec_id").withColumn("n", F.row_number().over(near)).where(F.col("n") <= k + 1)
    close = close.select("cell", "far", "vec_id").toArrow().to_pandas()  # at most pivots x (k + 1) rows
    close = close.sort_values("far").drop_duplicates("vec_id")  # so that k of any k + 1 are not the query
    sizes = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}
    asked_of = queries.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n")).collect()
    between = _distances(centre, centre)
    lifted_far = close["far"].to_numpy()
    from_pivot = close["cell"].to_numpy(np.int64)
    slack = 1e-6 * (1 + np.sqrt(most))  # rounding of the distances
    low, high = np.full((P, P), np.inf), np.full((P, P), -np.inf)  # [query cell, data cell]
    parts_of_query = {}
    for r in asked_of:
        i, radius = r["cell"], r["radius"]
        parts_of_query[i] = -(-r["n"] // part_rows)
        upper = np.sort(radius + between[i, from_pivot] + lifted_far)
        theta = upper[k] if len(upper) > k else np.inf
        low[i], high[i] = between[i] - radius - theta - slack, between[i] + radius + theta + slack
    parts_of_data = np.array([-(-sizes.get(j, 0) // part_rows) or 1 for j in range(P)])
    parts_list = [parts_of_query.get(i, 0) for i in range(P)]

    def part(ids: np.ndarray, parts: np.ndarray) -> np.ndarray:
        mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return (mixed % parts.astype(np.uint64)).astype(np.int64)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every data vector once for each part of each query cell that it may be a neighbour of."""
        for batch in batches:
            ids, far = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            cell = batch.column(2).to_numpy()
            own = part(ids, parts_of_data[cell])
            for i in range(P):
                hit = np.flatnonzero((far >= low[i, cell]) & (far <= high[i, cell])) if parts_list[i] else []
                if len(hit):
                    for share in range(parts_list[i]):
                        yield sent(batch, hit, np.full(len(hit), i), np.full(len(hit), share), cell[hit], own[hit])

    def sent(batch, at, i, share, j, own) -> pa.RecordBatch:
        at = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.asarray(x).astype(np.int32)) for x in (i, share, j, own)] + [batch.column(0).take(at), batch.column(1).take(at)],
            names=["i", "share", "j", "own", "vec_id", "v"],
        )

    data_parts = [(j, s) for j in range(P) for s in range(parts_of_data[j]) if sizes.get(j)]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every query once for each part of each data cell within its cell's bounds."""
        for batch in batches:
            ids, cell = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            share = part(ids, np.array([parts_list[c] for c in cell], np.int64)) if len(ids) else ids
            for j, s in data_parts:
                hit = np.flatnonzero(high[cell, j] >= 0)
                if len(hit):
                    yield sent(batch, hit, cell[hit], share[hit], np.full(len(hit), j), np.full(len(hit), s))

    pair = "i int, share int, j int, own int, vec_id long, v array<double>"
    keys = ["i", "share", "j", "own"]

    def solve(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(x):
            x = x.sort_values("vec_id", kind="stable")
            data_ids, query_ids = x["vec_id"].to_numpy(), q["vec_id"].to_numpy()
            a = matrix(pa.array(q["v"].tolist(), pa.list_(pa.float64())), dim)
            b = matrix(pa.array(x["v"].tolist(), pa.list_(pa.float64())), dim)
            step = max(1, (4 << 20) // len(b))
            for at in range(0, len(a), step):
                score = _products(a[at : at + step], b)
                for n, row in enumerate(score):
                    me = query_ids[at + n]
                    if len(row) > k + 64:  # the k best and all that tie with the last of them
                        own = int((data_ids == me).sum())
                        cut = np.partition(row, len(row) - min(len(row), k + own))[len(row) - min(len(row), k + own)]
                        hit = np.flatnonzero(row >= cut)
                    else:
                        hit = np.arange(len(row))
                    hit = hit[data_ids[hit] != me]
                    hit = hit[np.lexsort((data_ids[hit], -row[hit]))][:k]
                    tag = a[at + n].tobytes()
                    out += [(me, tag, int(data_ids[h]), int(row[h])) for h in hit]
        return pd.DataFrame(out, columns=["query_id", "tag", "vec_id", "score"])

    asked_parts = queries.mapInArrow(ask, pair).groupBy(*keys)
    sent_parts = placed.mapInArrow(replicate, pair).groupBy(*keys)
    best = asked_parts.cogroup(sent_parts).applyInPandas(solve, "query_id long, tag binary, vec_id long, score long")
    order = Window.partitionBy("query_id", "tag").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
