"""The exact search against brute force, and how much it leaves out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import neighbours


def brute(left, right, k):
    out = set()
    for q, v in left:
        near = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), i) for i, w in right if i != q)[:k]
        out |= {(q, i, round(d, 9), rank) for rank, (d, i) in enumerate(near, 1)}
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, v array<double>").withColumns({c: F.lit("x") for c in ("pivot", "r", "lot", "d", "block")})


def found(spark, left, right, k, **sizes):
    got, share = neighbours.search(table(spark, left), table(spark, right), "id", "v", k, **sizes)
    return {(r.id, r.neighbour, round(r.distance, 9), r["rank"]) for r in got.collect()}, share.first()


def test_clusters_leave_most_cells_out(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 20, (8, 6))
    rows = [(i, (centres[i % 8] + rng.normal(0, 1, 6)).tolist()) for i in range(1600)]
    left = [r for r in rows if r[0] % 100 == 0]
    got, share = found(spark, left, rows, 5, pivots=32, cell=40, block_bytes=200)
    assert got == brute(left, rows, 5)
    assert (share.queries, share.rows) == (16, 1600) and share.compared < 0.2 * 16 * 1600


@pytest.mark.parametrize("k", [1, 4])
def test_copies_ties_and_repeated_ids(spark, k):
    rows = [(i, [float(i % 5), 0.0]) for i in range(60)] + [(900, [1.0, 1.0])] * 3 + [(7, [100.0, 0.0])]
    left = [(0, [0.0, 0.0]), (900, [1.0, 1.0]), (5000, [3.5, -1.0])]
    assert found(spark, left, rows, k, pivots=3, cell=4)[0] == brute(left, rows, k)


def test_fewer_rows_than_asked_for_and_unusable_vectors(spark):
    good = [(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [5.0, 5.0])]
    bad = [(4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, []), (None, [1.0, 1.0])]
    assert found(spark, good + bad, good + bad, 5)[0] == brute(good, good, 5)
    for left, right in ((bad, good), (good, bad), ([], [])):
        got, share = found(spark, left, right, 2)
        assert got == set() and share.compared == 0


def test_scaling_by_training_rows(spark):
    rows = [(i, [float(i), 7.0, float(i * i)]) for i in range(10)]
    df = table(spark, rows)
    got = {r.id: r.v for r in neighbours.scaled(df, df.where("id < 5"), "v").collect()}
    x = np.array([v for _, v in rows])
    s = x[:5].std(0)
    want = (x - x[:5].mean(0)) / np.where(s == 0, 1, s)
    assert np.allclose([got[i] for i in range(10)], want)
