"""Hard-negative mining against brute force, and its edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import check
from tabledoc.llm import hard_negatives
from tabledoc.llm.queries import QUERIES


def _mined(rows, positives=5, negatives=3, margin=(50, 95), every=50, scale=256.0):
    """(anchor, positive, rank, negative, positive score, negative score) by loops over (id, vector, label)."""
    use = [
        (i, [int(np.floor(scale * x)) for x in v], g) for i, v, g in rows
        if i is not None and g is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out, answered = [], set()
    for i, v, g in use:
        if i % every or (i, tuple(v), g) in answered:
            continue
        answered.add((i, tuple(v), g))
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, h) for j, w, h in use if j != i)
        for p, j, _ in [s for s in scored if s[2] == g][:positives]:
            ok = [s for s in scored if s[2] != g and margin[0] * -p <= 100 * -s[0] <= margin[1] * -p]
            out += [(i, j, n, s[1], -p, -s[0]) for n, s in enumerate(ok[:negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("high,dim,bits", [(1, 3, 1), (40, 64, 20), (300, 64, 20), (1 << 20, 9, 60), (1 << 40, 4, 100), (1 << 62, 2, 130)])
def test_packed_products_are_exact(high, dim, bits):
    rng = np.random.default_rng(high)
    a, r = rng.integers(-high, high + 1, (13, dim)), rng.integers(-high // 2, high + 1, (29, dim))
    a[0], r[0], r[1] = high, high, -high // 2
    a[1], a[2], r[2] = -high, 0, 0
    want = np.array([[sum(int(x) * int(y) for x, y in zip(p, q)) for q in r] for p in a], object)
    ends = np.iinfo(np.int64)
    assert (hard_negatives.packed_scores(a, r)(a) == np.clip(want, ends.min, ends.max)).all()
    assert (hard_negatives.packed_scores(a, r)(a[3:4]) == np.clip(want[3:4], ends.min, ends.max)).all()


def test_several_rows_share_a_word():
    rng = np.random.default_rng(2)
    a, r = rng.integers(-130, 131, (4, 64)), rng.integers(-130, 131, (9, 64))
    assert 53 // hard_negatives._field(a - a.min(), r - r.min()) >= 2


@pytest.mark.parametrize("parts", [(1000, 1000), (2, 7), (1, 1000), (3, 40)])
def test_mining_of_clusters_and_edge_rows(spark, parts):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 6) + (i % 3 == 0)], int(i) % 4 if i % 11 else 0) for i in range(160)]
    rows += [(200, None, 1), (250, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (300, [float("nan")] * 6, 2), (350, [float("inf")] * 6, 2)]
    rows += [(None, [1.0] * 6, 1), (400, [1.0] * 6, None), (450, [0.5, 0.25], 1), (500, [], 2), (550, [0.0] * 6, 3)]
    rows += [rows[50], rows[60], (60, rows[3][1], 2), (100, rows[7][1], 3)]  # repeated rows, ids with two vectors
    rows += [(600, [0.3] * 6, 9), (601, [-0.3] * 6, 9)]  # a positive with a negative score
    rows += [(700 + n, rows[0][1], n % 2) for n in range(12)]  # ties
    data = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id bigint, embedding array<float>, label int, serial int, i int, v int")
    got = hard_negatives.mine(data, anchor_rows=parts[0], data_rows=parts[1]).collect()
    assert sorted(map(tuple, got)) == _mined(rows) and len(got) > 20


@pytest.mark.parametrize("scale", [1e-3, 2.0**30, 1e17])
def test_mining_of_small_and_huge_components(spark, scale):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(0.4, 0.3, 3)], i % 2) for i in range(101)]
    if scale == 1e17:
        rows = [(i, [x / 1e9 for x in v], g) for i, v, g in rows]
    got = hard_negatives.mine(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), scale=scale, data_rows=30)
    assert sorted(map(tuple, got.collect())) == _mined(rows, scale=scale)


def test_mining_of_nothing_and_of_one(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    for rows in ([], [(50, [1.0], 1)], [(50, None, 1)], [(50, [1.0], 1), (51, [1.0], 1)], [(50, [], 1), (1, [], 1), (2, [], 0)]):
        got = hard_negatives.mine(spark.createDataFrame(rows, schema)).collect()
        assert sorted(map(tuple, got)) == _mined(rows)


def test_label_may_be_a_column(spark):
    rows = [(i, [1.0 + (i % 5) / 10], i) for i in range(60)]
    data = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = hard_negatives.mine(data, label=F.col("label") % 2).collect()
    assert sorted(map(tuple, got)) == _mined([(i, v, g % 2) for i, v, g in rows])


def test_query_equals_its_sql(spark, sf_dir):
    problem, n = check.compare(spark, check.connect(sf_dir), "op12", QUERIES["op12_hard_negatives"].build, QUERIES["op12_hard_negatives"].oracle, sf_dir)
    assert problem is None and n
