"""Hard-negative mining by Kronecker-packed products.

Components become integers.  Several candidates are packed into one word per component: each candidate's
component is biased to be non-negative and put into a field of its own, wide enough for any inner product
with the biased anchors.  Multiplying the words once by an anchor's components, and adding up over the components,
leaves every candidate's product in its field, without carries between fields; taking the biases' part
away gives the exact scores.  Words are integers of up to 53 bits, kept in doubles so that the products of a
block are one matrix product; where a single field is wider than that, Python's integers hold the words.

Anchors and candidates are dealt into parts of bounded size by a row number, whatever their ids and labels.
Two passes meet each pair of parts in one task: the first finds the best rows of the anchor's own label, the
second the best of other labels inside the range of scores that each of those allows.  A task returns a few
rows for each anchor, which are merged by rank.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabledoc.llm.vectors import usable
from tabledoc.session import materialise

#: Rows of a part, about.  A candidate is sent once for each part of anchors, so those are larger.
ANCHOR_ROWS, DATA_ROWS = 1 << 14, 1 << 13
#: Scores worked on at a time.
CELLS = 1 << 21
_NONE = np.iinfo(np.int64).min
_EXACT = 53


def _field(anchors: np.ndarray, rows: np.ndarray) -> int:
    """Bits that hold any inner product of the non-negative rows of both."""
    most = max(map(int, anchors.max(0, initial=0)), default=0) * max(map(int, rows.max(0, initial=0)), default=0)
    return max(1, (most * anchors.shape[1]).bit_length())


def packed_scores(anchors: np.ndarray, rows: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Packs ``rows`` for products with any of ``anchors``; gives the function from some anchors to scores (anchors x rows).

    Vectors are integers.  Exact; products beyond the range of a long are held at its ends.
    """
    if not anchors.size or not rows.size:
        return lambda some: np.zeros((len(some), len(rows)), np.int64)
    # biases as Python's integers, as a difference of longs may not be one
    bias_a, bias_r = -int(anchors.min()), -int(rows.min())
    wide = max(int(anchors.max()), bias_a, int(rows.max()), bias_r) >= 1 << (_EXACT - 1)
    kind = object if wide else np.int64
    r = rows.astype(kind) + bias_r
    bits = _field(anchors.astype(kind) + bias_a, r)
    fields = _EXACT // bits
    if wide or not fields:
        kind, fields = object, max(2, 256 // bits)
        r = r.astype(object)
    groups, dim = -(-len(r) // fields), r.shape[1]
    each = np.zeros((groups * fields, dim), kind)
    each[: len(r)] = r
    each = each.reshape(groups, fields, dim)
    words = each[:, 0]
    for f in range(1, fields):
        words = words + each[:, f] * (1 << (bits * f))
    words = words.T if kind is object else words.T.astype(np.float64)
    of_row = bias_a * each.sum(2)

    def scores(some: np.ndarray) -> np.ndarray:
        a = some.astype(kind) + bias_a
        # one multiplication for each component of an anchor and word
        total = a @ words if kind is object else (a.astype(np.float64) @ words).astype(np.int64)
        # (a + A)(r + R) = a r + A sum(r + R) + R sum(a + A) - n A R, with the biases A and R
        of_anchor = bias_r * a.sum(1)[:, None] - dim * bias_a * bias_r
        out = np.zeros((len(a), groups, fields), kind)
        for f in range(fields):
            out[:, :, f] = ((total >> (bits * f)) & ((1 << bits) - 1)) - of_row[:, f] - of_anchor
        out = out.reshape(len(a), -1)[:, : len(rows)]
        if kind is object:
            ends = np.iinfo(np.int64)
            out = np.maximum(np.minimum(out, ends.max), ends.min).astype(np.int64)
        return out

    return scores


def _codes(column: pd.Series, dim: int) -> np.ndarray:
    """Integer vectors as a matrix; shorter ones are padded with zeros."""
    if (column.map(len) == dim).all():
        return np.concatenate(column.to_list()).reshape(len(column), dim).astype(np.int64)
    got = np.zeros((len(column), dim), np.int64)
    for i, v in enumerate(column):
        got[i, : len(v)] = v
    return got


def _best(scores: np.ndarray, ok: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The ``k`` highest allowed scores of each row as (rows, columns), round by round; ties to the first column."""
    left, out = np.where(ok, scores, _NONE), []
    for _ in range(k):
        at = left.argmax(1)
        rows = np.flatnonzero(left[np.arange(len(left)), at] > _NONE)
        if not len(rows):
            break
        out.append((rows, at[rows]))
        left[rows, at[rows]] = _NONE
    return out


def _tiles(anchors: DataFrame, rows: DataFrame, fields: str, parts: tuple[int, int], solve: Callable, result: str) -> DataFrame:
    """``solve(anchors, rows)`` of every pair of a part of anchors and a part of rows."""
    part = lambda n: F.pmod("serial", F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = anchors.withColumn("i", part(parts[0])).withColumn("j", every(parts[1]))
    b = rows.withColumn("j", part(parts[1])).withColumn("i", every(parts[0]))
    return a.groupBy("i", "j").cogroup(b.select("i", "j", *fields.split()).groupBy("i", "j")).applyInPandas(solve, result)


def mine(
    data: DataFrame, positives: int = 5, negatives: int = 3, margin: tuple[int, int] = (50, 95), every: int = 50, scale: float = 256.0,
    key: str = "vec_id", vector: str = "embedding", label: Column | str = "label",
    anchor_rows: int = ANCHOR_ROWS, data_rows: int = DATA_ROWS,
) -> DataFrame:
    """The best rows of other labels near every anchor and each of its positives.

    Every component x becomes floor(scale * x) in double precision; a row's score is its integer inner product with
    the anchor, higher scores come first, ties by the smaller id.  Anchors are the rows whose id is divisible by ``every``,
    an anchor's positives its first ``positives`` other rows of the same label.  For each of them the first ``negatives`` rows of
    other labels are returned whose score lies between ``margin`` per cent of the positive's:
    ``anchor_id, positive_id, rank`` (from 1), ``negative_id, positive_score, negative_score``.

    Rows without id or label, and vectors that are null or hold null or non-finite components, take no part; shorter
    vectors count as padded with zeros.  Rows that share the anchor's id are not its positives or negatives.  An anchor that
    is repeated with the same label and vector is answered once; a repeated row counts as often as it stands there, as positive
    and as negative.  Fewer than asked for give all there are, no rows give no rows.  Other columns are ignored.
    """
    whole = F.transform(F.col(f"`{vector}`"), lambda x: F.floor(x.cast("double") * scale))
    label = F.col(f"`{label}`") if isinstance(label, str) else label
    rows = data.where(F.col(f"`{key}`").isNotNull() & usable(F.col(f"`{vector}`")))
    rows = rows.select(F.col(f"`{key}`").cast("long").alias("vec_id"), label.cast("string").alias("label"), whole.alias("v"))
    rows = materialise(rows.where(F.col("label").isNotNull()).withColumn("serial", F.monotonically_increasing_id()), "vectors")
    # serials leave gaps between files, but deal evenly
    anchors = rows.where(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id", "label", "v"])
    anchors = materialise(anchors.select(F.col("vec_id").alias("anchor_id"), "label", "v", "serial"), "anchors")
    high = F.greatest(F.array_max("v"), -F.array_min(F.transform("v", lambda x: F.greatest(x, F.lit(_NONE + 1)))))
    found = rows.agg(F.max(F.size("v")).alias("dim"), F.max(high).alias("high"), F.count("*").alias("n")).first()
    dim, parts = found["dim"] or 0, (max(1, -(-anchors.count() // anchor_rows)), max(1, -(-found["n"] // data_rows)))
    # vectors travel as the shortest integers that hold them
    kind = "smallint" if (found["high"] or 0) < 1 << 15 else "bigint"
    rows, anchors = (x.withColumn("v", F.col("v").cast(f"array<{kind}>")) for x in (rows, anchors))

    def blocks(a: pd.DataFrame, x: pd.DataFrame):
        """Scores of a few anchors at a time with all rows, and which rows are others of the anchor's label."""
        x = x.sort_values("vec_id", kind="stable", ignore_index=True)  # so that ties go to the smaller id
        left = _codes(a["v"], dim)
        scores, ids = packed_scores(left, _codes(x["v"], dim)), x["vec_id"].to_numpy()
        labels = pd.factorize(pd.concat([a["label"], x["label"]]))[0]
        step = max(1, CELLS // len(x))
        for at in range(0, len(a), step):
            some = a.iloc[at : at + step]
            same = labels[at : at + len(some), None] == labels[None, len(a) :]
            other = some["anchor_id"].to_numpy()[:, None] != ids[None, :]
            yield some, x, scores(left[at : at + step]), same, other

    def near(a: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame(columns=["serial", "vec_id", "score"])]
        if len(a) and len(x):
            for some, x, scores, same, other in blocks(a, x):
                serial, ids = some["serial"].to_numpy(), x["vec_id"].to_numpy()
                for at, col in _best(scores, same & other, positives):
                    out.append(pd.DataFrame({"serial": serial[at], "vec_id": ids[col], "score": scores[at, col]}))
        return pd.concat(out[1:] or out)

    best = _tiles(anchors, rows, "vec_id label v", parts, near, "serial long, vec_id long, score long")
    first = Window.partitionBy("serial").orderBy(F.desc("score"), "vec_id")
    chosen = best.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= positives)
    # at most `positives` for each anchor
    pairs = chosen.groupBy("serial").agg(F.array_sort(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("positives"))
    pairs = materialise(pairs, "positives")
    asked = materialise(
        anchors.join(pairs, "serial").select(
            "serial", "anchor_id", "label", "v",
            *[F.get("positives", F.lit(n))["score"].alias(f"p{n}") for n in range(positives)],
        ),
        "anchors",
    )
    low, top = margin

    def far(a: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame(columns=["serial", "nth", "vec_id", "score"])]
        if len(a) and len(x):
            for some, x, scores, same, other in blocks(a, x):
                serial, ids, ok = some["serial"].to_numpy(), x["vec_id"].to_numpy(), ~same & other
                for n in range(positives):
                    has = some[f"p{n}"].notna().to_numpy()
                    p = [int(v) for v in some[f"p{n}"].where(has, 0)]
                    least = np.array([-(-low * v // 100) for v in p])[:, None]
                    most = np.array([top * v // 100 for v in p])[:, None]
                    for at, col in _best(scores, ok & has[:, None] & (scores >= least) & (scores <= most), negatives):
                        out.append(pd.DataFrame({"serial": serial[at], "nth": n + 1, "vec_id": ids[col], "score": scores[at, col]}))
        return pd.concat(out[1:] or out)

    hard = _tiles(asked, rows, "vec_id label v", parts, far, "serial long, nth int, vec_id long, score long")
    order = Window.partitionBy("serial", "nth").orderBy(F.desc("score"), "vec_id")
    hard = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    of = asked.select("serial", "anchor_id").join(pairs, "serial")
    positive = F.get("positives", F.col("nth") - 1)
    return hard.join(of, "serial").select(
        "anchor_id", positive["vec_id"].alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"), positive["score"].alias("positive_score"), F.col("score").alias("negative_score"),
    )
