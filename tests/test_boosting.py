"""Boosted trees against a builder that sorts nothing into histograms and sums by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions.draws import poisson, uniform
from quern.operators import boosting

COLUMNS = ["a", "b", "c"]


def table(spark, n=240, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b, c = float(rng.integers(0, 12)), float(rng.normal()), [None, float("nan"), 1.0, 2.0][int(rng.integers(0, 4))]
        y = int(rng.random() < 1 / (1 + np.exp(-(a - 6) * 0.8 - b * (c or 0) * 1.5))) if c == c else int(rng.random() < 0.8)
        rows.append((i, a, None if i % 17 == 0 else b, c, y, i % 4))
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y int, fold int")


def brute(model, rows, m, used, rounds, depth, share, seed, l2=1.0, least=1.0, rate=0.1, draw=0.9):
    """Margins of all rows after each round, from plain recursion over lists of row numbers."""
    codes = model.codes(np.array([[np.nan if r[c] is None else r[c] for c in COLUMNS] for r in rows]))
    key, y = np.array([r["k"] for r in rows]), np.array([float(r["y"]) for r in rows])
    margin = np.full(len(rows), model.base[m])
    rng, most = np.random.default_rng(seed), max(1, round(share * len(COLUMNS)))
    for turn in range(rounds):
        chosen = [sorted(rng.choice(range(len(COLUMNS)), most, replace=False).tolist()) for _ in model.base][m]
        g, h = boosting.gradients(y, margin)
        drawn = uniform(key, seed, turn) < draw
        score = lambda p: (sum(int(g[i]) for i in p) / boosting.SCALE) ** 2 / (sum(int(h[i]) for i in p) / boosting.SCALE + l2)
        out = np.zeros(len(rows))

        def grow(learn, every, level):
            best = (0.0,)
            for c in chosen if level < depth else []:
                for left in (False, True):
                    if left and not any(codes[i, c] == 255 for i in learn):
                        continue
                    for e in range(len(model.edges[c])):
                        goes = lambda i: left if codes[i, c] == 255 else codes[i, c] <= e  # noqa: B023, E731
                        a = [i for i in learn if goes(i)]
                        b = [i for i in learn if not goes(i)]
                        if min(sum(int(h[i]) for i in a), sum(int(h[i]) for i in b)) < least * boosting.SCALE:
                            continue
                        gain = score(a) + score(b) - score(learn)
                        if gain > best[0]:
                            best = (gain, c, left, e)
            if len(best) == 1:
                w = -rate * (sum(int(g[i]) for i in learn) / boosting.SCALE) / (sum(int(h[i]) for i in learn) / boosting.SCALE + l2)
                out[every] = w
                return
            _, c, left, e = best
            goes = lambda i: left if codes[i, c] == 255 else codes[i, c] <= e
            for side in (True, False):
                grow([i for i in learn if goes(i) == side], [i for i in every if goes(i) == side], level + 1)

        grow([i for i in range(len(rows)) if used[i] and drawn[i]], list(range(len(rows))), 0)
        margin = margin + out
    return margin


@pytest.mark.parametrize("models", [1, 2])
def test_trees_equal_a_plain_builder(spark, models, monkeypatch):
    monkeypatch.setattr(boosting, "KEPT_TREES", 2)
    df = table(spark).repartition(5)
    uses = F.when(F.col("fold") == 0, 2).otherwise(3) if models == 2 else None
    model = boosting.fit(df, COLUMNS, "id", uses=uses, models=models, rounds=5, depth=3, share=0.7, seed=11)
    rows = [r.asDict() for r in df.withColumn("k", F.xxhash64("id")).orderBy("id").collect()]
    got = {r.id: r.scores for r in model.score(df).collect()}
    for m in range(models):
        used = [m == 1 or models == 1 or r["fold"] != 0 for r in rows]
        want = brute(model, rows, m, used, 5, 3, 0.7, 11)
        assert np.allclose([got[r["id"]][m] for r in rows], 1 / (1 + np.exp(-want)), atol=1e-9)
    assert any((t.column >= 0).sum() > 3 for t in model.trees[0])


def test_partitions_do_not_matter(spark):
    df = table(spark)
    a, b = (boosting.fit(df.repartition(n), COLUMNS, "id", rounds=3, depth=3) for n in (1, 7))
    for x, y in zip(a.trees[0], b.trees[0]):
        assert np.array_equal(x.column, y.column) and np.array_equal(x.edge, y.edge) and np.array_equal(x.value, y.value)


def test_folds_are_held_out_and_learnt_from(spark):
    df = table(spark, 600)
    out = boosting.leave_fold_out(df, COLUMNS, "id", k=4, rounds=12, depth=3)
    rows = out.collect()
    assert len(rows) == 1200
    assert all(r.fold == (r.turn if r.role == "test" else (r.turn + 1) % 4) for r in rows)
    pos, neg = ([r.score for r in rows if r.role == "test" and r.y == v] for v in (1, 0))
    assert np.mean([p > q for p in pos for q in neg]) > 0.8


@pytest.mark.parametrize("rows", [[], [(1, 1.0, None, None, 1, 0)], [(k, None, None, None, 1, 0) for k in range(4)], [(k, float("inf"), 1.0, None, k % 2, 0) for k in range(40)] + [(None, 1.0, 1.0, 1.0, None, None)]])
def test_tables_with_nothing_to_split(spark, rows):
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y int, fold int").withColumn("model", F.lit("clash"))
    model = boosting.fit(df, COLUMNS, "id", rounds=2, depth=2)
    assert model.score(df).count() == len(rows)


def test_draws_have_their_law():
    units = np.arange(200_000)
    u = uniform(units, 1, 2)
    assert abs(u.mean() - 0.5) < 0.005 and abs(np.corrcoef(u, uniform(units, 1, 3))[0, 1]) < 0.01
    n = poisson(units, 4)
    assert abs(n.mean() - 1) < 0.01 and abs(n.var() - 1) < 0.02
    assert poisson(units[:5, None], np.arange(3)[None, :]).shape == (5, 3)
