"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its letter n-grams (1 to 3 code points within a word and its
edges), hashed into a fixed number of buckets.  Embeddings and softmax are trained together by
stochastic gradient descent on a bounded sample, then calibrated on a part of it that was held back:
a temperature makes the confidences honest, and the rejection threshold is the confidence that all
but a small share of correctly predicted texts reach.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabledoc.llm.arrow_text import aside, codepoints, in_small_batches, list_array, slices
from tabledoc.llm.samples import chosen_ids, texts_of

BUCKETS, DIM = 1 << 14, 16
UNKNOWN = "und"


@lru_cache(1)
def _fold() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: its lower case if it is part of a word, else 0; and whether it is a letter."""
    fold, letter = np.zeros(0x110000, np.uint32), np.zeros(0x110000, bool)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            low = chr(c).lower()
            fold[c] = ord(low) if len(low) == 1 else c
            letter[c] = kind == "L"
    return fold, letter


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all texts in order, how many each text has, and whether it has a letter."""
    fold, letter = _fold()
    points, rows = codepoints(data), len(offsets) - 1
    ends = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]  # code points before each text
    has = np.zeros(rows, bool)
    full = np.flatnonzero(np.diff(ends))
    if len(full):
        has[full] = np.logical_or.reduceat(letter[points], ends[:-1][full])
    x = np.insert(fold[points], ends[1:], 0)  # a gap after every text
    of = np.repeat(np.arange(rows), np.diff(ends) + 1)
    keep = (x != 0) | np.concatenate(([True], x[:-1] != 0))[: len(x)]
    x, of = np.concatenate(([0], x[keep], [0, 0])).astype(np.uint32), np.concatenate(([0], of[keep], [0, 0]))
    a, b, c = x[:-2], x[1:-1], x[2:]
    one, two, three = a * np.uint32(2654435761), (a * np.uint32(40503) ^ b) * np.uint32(2246822519), None
    three = (two ^ c) * np.uint32(3266489917)
    made = np.stack([one, two, three], 1)
    # an n-gram may begin or end at a word's edge but not go past it
    ok = np.stack([a != 0, (a != 0) | (b != 0), (b != 0) & ((a != 0) | (c != 0))], 1)
    owner = np.where(a != 0, of[:-2], of[1:-1])
    buckets = (made >> np.uint32(18)).astype(np.int32)[ok]
    counts = np.bincount(np.repeat(owner, ok.sum(1)), minlength=rows)
    return buckets, counts, has


@dataclass(frozen=True)
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    reject_below: float


def sample(
    docs: DataFrame, per_language: int, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = 50_000,
) -> DataFrame:
    """``lang, text``: at most ``per_language`` labelled texts of each language, chosen by a hash of the id.

    With very many languages each has less, so that there are no more than ``most`` in all (one of each
    language at least).  Null ids, texts and languages are left out, and repeated ids give one text.
    """
    rows = docs.select(F.col(key).alias("_id"), F.col(lang).alias("_group"), F.col(text).alias("text"))
    labelled = rows.where(F.col("text").isNotNull()).select("_id", "_group")
    languages = labelled.select(F.approx_count_distinct("_group")).first()[0]
    ids = chosen_ids(labelled, max(1, min(per_language, most // max(1, languages))))
    return texts_of(rows, ids, ["_id", "_group"]).select(F.col("_group").alias("lang"), "text")


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def fit(
    docs: DataFrame, per_language: int = 1000, key: str = "doc_id", text: str = "text", lang: str = "lang",
    epochs: int = 12, least_steps: int = 1500, rate: float = 0.5, rejected_share: float = 0.001, seed: int = 7,
) -> Model:
    """Train on at most ``per_language`` whole texts of each language (null languages and texts are no labels).

    The driver holds the sample as counts of hashed n-grams, at most ``BUCKETS`` a text.
    """
    chosen = sample(docs, per_language, key, text, lang)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, offsets, data in slices(batch, "text"):
                buckets, counts, _ = grams(data, offsets)
                got = [np.unique(part, return_counts=True) for part in np.split(buckets, np.cumsum(counts)[:-1])]
                size = np.concatenate(([0], np.cumsum([len(g[0]) for g in got])))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0), list_array(np.concatenate([g[0] for g in got]), size, pa.int32()),
                        list_array(np.concatenate([g[1] for g in got]).astype(np.int32), size, pa.int32()),
                    ],
                    names=["lang", "bucket", "n"],
                )

    rows = in_small_batches(chosen).mapInArrow(featurise, "lang string, bucket array<int>, n array<int>").toArrow().to_pandas()
    rows = rows[rows["bucket"].map(len) > 0].reset_index(drop=True)
    # in one order however Spark dealt them, so that runs agree
    rows = rows.iloc[sorted(range(len(rows)), key=lambda i: (rows["lang"][i], rows["bucket"][i].tobytes(), rows["n"][i].tobytes()))].reset_index(drop=True)
    languages = sorted(rows["lang"].unique())
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    target = rows["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy()
    parts = [(b, (n / n.sum()).astype(np.float32)) for b, n in zip(rows["bucket"], rows["n"])]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(parts))
    held, train = order[: len(order) // 5], order[len(order) // 5 :]
    embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    weight, bias = np.zeros((DIM, len(languages)), np.float32), np.zeros(len(languages), np.float32)

    def dense(at: np.ndarray) -> np.ndarray:
        x = np.zeros((len(at), BUCKETS), np.float32)
        for i, n in enumerate(at):
            x[i, parts[n][0]] = parts[n][1]
        return x

    epochs = max(epochs, -(-least_steps // max(1, -(-len(train) // 32))))  # a small sample is gone through more often
    steps, done, size = epochs * -(-len(train) // 32), 0, np.float32(BUCKETS / 64)
    for _ in range(epochs):
        rng.shuffle(train)
        for at in range(0, len(train), 32):
            batch = train[at : at + 32]
            x = dense(batch)
            mean = x @ embed
            error = _softmax(mean @ weight + bias)
            error[np.arange(len(batch)), target[batch]] -= 1
            error *= np.float32(rate * (1 - done / steps) / len(batch))
            back = x.T @ (error @ weight.T)
            weight -= mean.T @ error * np.float32(10)
            bias -= error.sum(0)
            embed -= back * size  # a bucket has a small part of a text's mean, so its steps are longer
            done += 1
    table = embed @ weight
    if not len(held):
        return Model(languages, table, bias, 1.0, 0.0)
    logits = np.vstack([dense(held[i : i + 64]) @ table + bias for i in range(0, len(held), 64)])
    own = target[held]
    loss = lambda t: -np.log(np.maximum(1e-12, _softmax(logits / t)[np.arange(len(own)), own])).mean()
    temperature = float(min(np.geomspace(0.1, 10, 41), key=loss))
    sure = _softmax(logits / temperature)
    good = np.sort(sure.max(1)[sure.argmax(1) == own])
    below = float(good[int(rejected_share * len(good))]) if len(good) else 0.0
    return Model(languages, table.astype(np.float32), bias, temperature, below * (1 - 1e-6))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``lang_pred, score, rejected`` to every row.

    ``score`` is the calibrated confidence.  Texts that are null or have no letter are ``und`` with score
    0 and rejected, as are all texts of a model without languages; others are rejected when the score is
    below the model's threshold.  Columns of the input with these names are replaced.  Row-local.
    """
    added = ("lang_pred", "score", "rejected")
    df, back = aside(docs, [text], [c for c in docs.columns if c not in added])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            for rows, offsets, data in slices(batch, text):
                buckets, counts, has = grams(data, offsets)
                total = np.zeros((len(counts), len(model.languages)))
                full = np.flatnonzero(counts)
                if len(full) and len(model.languages):
                    total[full] = np.add.reduceat(model.table[buckets], (np.cumsum(counts) - counts)[full], dtype=np.float64)
                known = has & (counts > 0) & (len(model.languages) > 0)
                best, score = np.full(len(has), len(model.languages)), np.zeros(len(has))
                if known.any():
                    sure = _softmax((total[known] / counts[known, None] + model.bias) / model.temperature)
                    best[known], score[known] = sure.argmax(1), sure.max(1)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(names[best], pa.string()), pa.array(score), pa.array(~known | (score < model.reject_below))],
                    names=[*rows.schema.names, *added],
                )

    found = in_small_batches(df).mapInArrow(run, f"{fields}, lang_pred string, score double, rejected boolean")
    return found.select(*back, *added)
