"""Quality classifier: a sparse ensemble of rules over text statistics.

Small boosted trees are grown on a bounded labelled sample; every path from a root to a node is a
rule, a conjunction of comparisons.  A lasso logistic regression over the rules keeps few of them,
and these are compiled into one Spark column expression, which scores every row inside the engine.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabledoc.llm.arrow_text import aside, in_small_batches, slices
from tabledoc.llm.joins import small_side
from tabledoc.llm.samples import chosen_ids, texts_of

#: Classes of bytes: other, lower, upper, digit, blank, line break, sentence mark, symbol, beyond ASCII.
_CLASS = np.zeros(256, np.uint8)
for _chars, _kind in (
    (b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3), (b" \t", 4), (b"\r\n", 5),
    (b".,;:?'\"()-", 6), (b"!#$%&*+/<=>@[\\]^_`{|}~", 7),
):
    _CLASS[list(_chars)] = _kind
_CLASS[128:] = 8
STATISTICS = (
    "chars", "words", "word_length", "upper", "digits", "symbols", "marks", "beyond_ascii", "repeats", "distinct",
    "top_word", "lines", "line_repeats", "line_words", "marked_words",
)


def _row(counts: np.ndarray, words: list[bytes], lines: list[bytes]) -> tuple[float, ...]:
    n = len(words)
    size = float(counts.sum())
    letters = float(counts[1] + counts[2] + counts[8]) or 1.0
    solid = float(size - counts[4] - counts[5]) or 1.0
    seen = Counter(words)
    filled = [x for x in lines if x]
    return (
        size, float(n), (solid / n if n else 0.0), counts[2] / letters, counts[3] / solid, counts[7] / solid, counts[6] / solid,
        counts[8] / solid, (sum(map(eq, words, words[1:])) / (n - 1) if n > 1 else 0.0), (len(seen) / n if n else 1.0),
        (max(seen.values()) / n if n else 0.0), float(len(filled)), (1 - len(set(filled)) / len(filled) if filled else 0.0),
        (n / len(filled) if filled else 0.0), (counts[7] / n if n else 0.0),
    )


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds a double column for each of ``STATISTICS`` (whole texts; null counts as empty).

    Columns of the input with these names are replaced.  Row-local.
    """
    df, back = aside(docs, [text], [c for c in docs.columns if c not in STATISTICS])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, offsets, data in slices(batch, text):
                raw, at = data.tobytes(), offsets.tolist()
                kinds = _CLASS[data]
                out = []
                for a, b in zip(at, at[1:]):
                    doc = raw[a:b]
                    out.append(_row(np.bincount(kinds[a:b], minlength=9), doc.split(), doc.split(b"\n")))
                table = np.array(out, float).reshape(len(out), len(STATISTICS))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, *[pa.array(np.ascontiguousarray(c)) for c in table.T]], names=[*rows.schema.names, *STATISTICS]
                )

    return in_small_batches(df).mapInArrow(run, fields + "".join(f", {s} double" for s in STATISTICS)).select(*back, *STATISTICS)


@dataclass(frozen=True)
class Rule:
    """A conjunction: for each statistic named, low < value <= high."""

    bounds: tuple[tuple[str, float, float], ...]
    weight: float

    def column(self) -> Column:
        out = F.lit(True)
        for name, low, high in self.bounds:
            if low > -np.inf:
                out = out & (F.col(name) > F.lit(low))
            if high < np.inf:
                out = out & (F.col(name) <= F.lit(high))
        return out


@dataclass(frozen=True)
class Model:
    rules: list[Rule]
    bias: float

    def score(self) -> Column:
        """Probability of label 1 as an expression over the statistics."""
        z = F.lit(self.bias)
        for rule in self.rules:
            z = z + F.when(rule.column(), F.lit(rule.weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def _bin(x: np.ndarray, bins: int) -> tuple[np.ndarray, list[np.ndarray]]:
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    return np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], 1), cuts


def tree_paths(x: np.ndarray, y: np.ndarray, trees: int, depth: int, bins: int = 48, rate: float = 0.3, seed: int = 3) -> list[tuple]:
    """Paths to all nodes of boosted trees, as bounds ``(statistic, low, high)`` in bins' cut values."""
    binned, cuts = _bin(x, bins)
    rng = np.random.default_rng(seed)
    margin, found = np.zeros(len(y)), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p) + 1e-6
        rows = rng.random(len(y)) < 0.7
        use = rng.permutation(x.shape[1])[: max(3, x.shape[1] * 2 // 3)]
        level = [((), rows, np.ones(len(y), bool))]
        for d in range(depth + 1):
            deeper = []
            for path, inside, everywhere in level:
                if path:
                    found[path] = None
                if d == depth or inside.sum() < 20:
                    margin[everywhere] += rate * grad[inside].sum() / (hess[inside].sum() + 1)
                    continue
                best = (1e-3, None, None)
                for f in use:
                    g = np.cumsum(np.bincount(binned[inside, f], grad[inside], len(cuts[f]) + 1))
                    h = np.cumsum(np.bincount(binned[inside, f], hess[inside], len(cuts[f]) + 1))
                    gain = (g**2 / (h + 1) + (g[-1] - g) ** 2 / (h[-1] - h + 1) - g[-1] ** 2 / (h[-1] + 1))[:-1]
                    if len(gain) and gain.max() > best[0]:
                        best = (gain.max(), f, int(gain.argmax()))
                if best[1] is None:
                    margin[everywhere] += rate * grad[inside].sum() / (hess[inside].sum() + 1)
                    continue
                _, f, cut = best
                below = binned[:, f] <= cut
                for side, mask in ((0, below), (1, ~below)):
                    deeper.append((_narrow(path, f, cuts[f][cut], side), inside & mask, everywhere & mask))
            level = deeper
    return list(found)


def _narrow(path: tuple, f: int, cut: float, side: int) -> tuple:
    bounds = {g: (low, high) for g, low, high in path}
    low, high = bounds.get(f, (-np.inf, np.inf))
    bounds[f] = (low, min(high, float(cut))) if side == 0 else (max(low, float(cut)), high)
    return tuple((g, *bounds[g]) for g in sorted(bounds))


def lasso(r: np.ndarray, y: np.ndarray, strength: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression with an absolute-value penalty, by accelerated proximal gradient."""
    n, k = r.shape
    w, b, v, c, t = np.zeros(k, np.float32), 0.0, np.zeros(k, np.float32), 0.0, 1.0
    step = 1.0
    q = np.ones(k) / np.sqrt(max(k, 1))
    for _ in range(12):  # the largest curvature, by power iteration
        q = r.T @ (r @ q.astype(np.float32))
        size = float(np.linalg.norm(q)) or 1.0
        q = q / size
    step = 1 / (0.25 * size / n + 0.3)
    for _ in range(steps):
        error = (1 / (1 + np.exp(-(r @ v + c))) - y).astype(np.float32)
        new = v - step * (r.T @ error) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * strength, 0)
        bias = c - step * float(error.mean())
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = (new + (t - 1) / later * (new - w)).astype(np.float32)
        c = bias + (t - 1) / later * (bias - b)
        w, b, t = new, bias, later
    return w, b


def fit(
    docs: DataFrame, labels: DataFrame, most: int = 12_000, trees: int = 40, depth: int = 3, key: str = "doc_id",
    label: str = "quality", text: str = "text",
) -> Model:
    """Fit on at most ``most`` labelled documents, chosen by a hash of the id (nulls are no labels).

    Repeated ids are one document, with the mean of their labels (from 0.5 on it counts as good).

    Only the statistics of the texts are inputs.  Without labels of both kinds the score is their mean.
    """
    marked = labels.where(F.col(label).isNotNull()).select(F.col(key).alias("_id"), F.col(label).alias("_y"))
    ids = chosen_ids(marked.select("_id", F.lit(0).alias("_group")), most).select("_id")
    # an id marked differently counts by the mean of its marks
    marks = marked.join(small_side(ids), "_id").groupBy("_id").agg(F.avg(F.col("_y").cast("double")).alias("_y"))
    chosen = texts_of(docs.select(F.col(key).alias("_id"), F.col(text).alias("text")), marks, ["_id"])
    rows = statistics(chosen).drop("text").toArrow().to_pandas().sort_values(["_id", "_y"])
    y = (rows["_y"].to_numpy(float) >= 0.5).astype(float)
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    if len(np.unique(y)) < 2:
        return Model([], float(np.log(mean / (1 - mean))))
    x = rows[list(STATISTICS)].to_numpy(float)
    paths = tree_paths(x, y, trees, depth)
    fires = np.ones((len(y), len(paths)), np.float32)
    for i, path in enumerate(paths):
        for f, low, high in path:
            fires[:, i] *= (x[:, f] > low) & (x[:, f] <= high)
    rng = np.random.default_rng(5)
    held = rng.random(len(y)) < 0.2

    def loss(strength: float) -> float:
        w, b = lasso(fires[~held], y[~held], strength, 200)
        p = np.clip(1 / (1 + np.exp(-(fires[held] @ w + b))), 1e-6, 1 - 1e-6)
        return -(y[held] * np.log(p) + (1 - y[held]) * np.log(1 - p)).mean() if held.any() else strength

    w, b = lasso(fires, y, min((3e-3, 1e-3, 3e-4), key=loss))
    kept = [
        Rule(tuple((STATISTICS[f], low, high) for f, low, high in paths[i]), float(w[i])) for i in np.flatnonzero(np.abs(w) > 1e-4)
    ]
    return Model(kept, float(b))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 if the score is at least 0.5) to every row.

    Null and empty texts are scored by the statistics of an empty text; repeated rows alike; other columns
    are kept, and those with these two names replaced.
    """
    # the statistics get names of their own, so that no column of the input is taken for one
    inner, back = aside(docs, [text], [c for c in docs.columns if c not in ("score", "predicted")])
    out = statistics(inner, text).select(*back, model.score().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
