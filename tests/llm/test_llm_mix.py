"""The curriculum mix against brute force, and its edge cases."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import check
from tabledoc.llm import curriculum
from tabledoc.llm.curriculum import Schedule
from tabledoc.llm.queries import QUERIES

FLAT = Schedule(((0.0, 1.0), (1.0, 1.0)))


def _targets(sizes, weights, share, repeats):
    """Water-filling by plain rounds: whoever is above the cap is set to it, the others share the rest by weight."""
    budget, capped = share * sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        rest = budget - sum(repeats * sizes[i] for i in capped)
        total = sum(weights[i] for i in free)
        target = {i: rest * weights[i] / total for i in free} | {i: float(repeats * sizes[i]) for i in capped}
        above = {i for i in free if target[i] > repeats * sizes[i]}
        if not above:
            return [target[i] for i in range(len(sizes))]
        capped |= above


def _mixed(rows, weights=(5, 2, 1), share=1.5, repeats=2):
    """(id, size, source size, target, taken) of (id, text, source) rows."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    whole = [sum(n for n, r in zip(size, rows) if r[2] == s) for s in names]
    target = _targets(whole, [weights[i % len(weights)] for i in range(len(names))], share, repeats)
    drawn = lambda n: int(hashlib.md5(f"{'' if rows[n][0] is None else rows[n][0]}:{size[n]}".encode()).hexdigest()[:13], 16)
    out = []
    for s, total, t in zip(names, whole, target):
        left = int(np.floor(t + 0.5))
        taken = dict.fromkeys((n for n in range(len(rows)) if rows[n][2] == s), 0)
        for _ in range(repeats):
            for n in sorted(taken, key=drawn):
                got = min(left, size[n])
                taken[n] += got
                left -= got
        out += [(rows[n][0], size[n], total, t, k) for n, k in taken.items()]
    return out


def _same(got, want):
    plain = lambda r: tuple("null" if x is None else round(float(x), 6) for x in r)
    assert sorted(map(str, map(plain, got))) == sorted(map(str, map(plain, want)))


EDGE = [
    (1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (3, "", "y"), (None, "one word \t two\x0bthree", "y"), (4, "word " * 40, None),
    (5, " \n ", "z"), (6, "w " * 3000, "\U0001f600"), (7, "w " * 10, "￿"), (8, "q r", "x"), (9, "s", "x"),
]


@pytest.mark.parametrize("share,repeats", [(1.5, 2), (0.3, 2), (2.0, 2), (3.0, 2), (2.5, 4)])
def test_mix_of_edge_rows(spark, share, repeats):
    # columns with the names of added ones and of the operator's own
    data = spark.createDataFrame([(*r, 5, 6, 7) for r in EDGE], "doc_id bigint, text string, source string, size int, _size int, target int")
    out = curriculum.mix(data, share=share, repeats=repeats, carry=("_size", "size", "text", "doc_id"))
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken", "position", "copies", "_size", "text"]
    got = out.collect()
    if share <= repeats:
        _same([r[:5] for r in got], _mixed(EDGE, share=share, repeats=repeats))
    else:
        assert all(r["taken"] == repeats * r["size"] for r in got)
    assert all(r["taken"] <= repeats * r["size"] and r["taken"] == sum(c["words"] for c in r["copies"]) for r in got)
    assert {(r["doc_id"], r["text"]) for r in got} == {r[:2] for r in EDGE} and all(r["_size"] == 6 for r in got)


def test_mix_of_nothing_and_of_no_words(spark):
    schema = "doc_id bigint, text string, source string"
    assert curriculum.mix(spark.createDataFrame([], schema)).count() == 0
    got = curriculum.mix(spark.createDataFrame([(1, None, None), (2, " ", "a")], schema)).collect()
    assert {tuple(r[:6]) for r in got} == {(1, 0, 0, 0.0, 0, None), (2, 0, 0, 0.0, 0, None)}
    assert curriculum.training_order(curriculum.mix(spark.createDataFrame([(1, None, None)], schema))).count() == 0


def test_hot_source_of_equal_rows(spark, monkeypatch):
    """A bucket holds a part of the rows of one source, and of rows that are equal."""
    rows = [(7, "a b c", "hot")] * 300 + [(i, "w " * (i % 9), "hot" if i % 3 else f"s{i % 7}") for i in range(600)]
    want = _mixed(rows)
    monkeypatch.setattr(curriculum, "BUCKET_ROWS", 50)
    got = curriculum.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).select("doc_id", "size", "source_size", "target", "taken")
    _same(got.collect(), want)


@pytest.mark.parametrize("schedule", [
    *curriculum.SCHEDULES, Schedule(((0.0, 0.0), (0.25, 4.0), (0.5, 0.0), (0.75, 0.0), (1.0, 1.0))), Schedule(((0.0, 1.0), (0.1, 0.0), (1.0, 0.0))),
])
def test_times_invert_the_integral(spark, schedule):
    shares = np.linspace(0, 1, 101)
    data = spark.createDataFrame([(float(x),) for x in shares], "x double")
    times = np.array([r[0] for r in data.select(schedule.time_of(F.col("x"))).collect()])
    knots = np.array(schedule.knots)
    grid = np.linspace(0, 1, 200_001)
    weight = np.interp(grid, knots[:, 0], knots[:, 1])
    used = np.concatenate(([0], np.cumsum((weight[1:] + weight[:-1]) / 2))) / ((weight[1:] + weight[:-1]) / 2).sum()
    assert (np.diff(times) >= 0).all() and np.allclose(np.interp(times, grid, used), shares, atol=1e-4)


def test_schedules_must_cover_the_training():
    for knots in (((0, 1),), ((0, 1), (0.5, 1)), ((0, 1), (0, 1), (1, 1)), ((0, -1), (1, 1)), ((0, 0), (1, 0))):
        with pytest.raises(ValueError):
            Schedule(knots)


def test_training_order_follows_the_schedules(spark):
    """At every time the sources' shares of words are those of their schedules."""
    rows = [(i, "w " * (1 + i % 5), "abc"[i % 3]) for i in range(6000)]
    mixed = curriculum.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), share=0.5)
    out = curriculum.training_order(mixed).toPandas()
    assert out["position"].is_monotonic_increasing and out["words"].sum() == mixed.agg(F.sum("taken")).first()[0]
    source = out["doc_id"].map(lambda i: "abc"[i % 3])
    for low in np.arange(0, 1, 0.1):
        part = (out["position"] >= low) & (out["position"] < low + 0.1)
        words = out["words"][part].groupby(source[part]).sum()
        mid = low + 0.05
        weights = {"a": 7 - 4 * mid, "b": 2.0, "c": 2 * mid}
        for s, w in weights.items():
            assert words.get(s, 0) / words.sum() == pytest.approx(w / sum(weights.values()), abs=0.02)


def test_chosen_schedules(spark):
    rows = [(i, "w w", s) for i in range(40) for s in "ab"]
    data = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    two = (FLAT, Schedule(((0.0, 3.0), (1.0, 3.0))))
    got = {r["source"]: r["target"] for r in curriculum.mix(data, schedules=two, choose=1 - F.col("nth"), share=0.5, carry=("source",)).collect()}
    assert got == {"a": 60.0, "b": 20.0}


def test_query_equals_its_sql(spark, sf_dir):
    problem, _ = check.compare(spark, check.connect(sf_dir), "op11", QUERIES["op11_source_mix"].build, QUERIES["op11_source_mix"].oracle, sf_dir)
    assert problem is None
