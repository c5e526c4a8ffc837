"""Resampled average precision against the same draws by hand, and closures with hubs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions.draws import poisson
from quern.operators import graph, statistics


def precision(scores, y, w):
    """Step-wise, ties in groups, rows counting as often as they are drawn."""
    tp = fp = out = 0.0
    for s in sorted(set(scores), reverse=True):
        own = [k for k, x in enumerate(scores) if x == s]
        p, n = sum(w[k] for k in own if y[k]), sum(w[k] for k in own if not y[k])
        tp, fp = tp + p, fp + n
        out += tp / (tp + fp) * p if tp + fp else 0.0
    return out / tp if tp else None


@pytest.mark.parametrize("tied", [False, True])
def test_replicates_equal_plain_ones(spark, tied, monkeypatch):
    monkeypatch.setattr(statistics, "SCORE_RANGES", 5)
    rng = random.Random(2)
    rows = [(f"u{k % 30}", rng.random() < 0.4, rng.random() if not tied or k % 3 else 0.5, rng.gauss(0, 3)) for k in range(300)]
    if tied:  # a hot score, and rows that count nothing
        rows = [(u, y, a, 7.0 if k % 2 else b) for k, (u, y, a, b) in enumerate(rows)]
    extra = [("u1", None, 0.1, 0.1), ("u2", True, None, 0.2)]
    df = spark.createDataFrame(rows + extra, "u string, y boolean, score_a double, score_b double").withColumn("y", F.col("y").cast("int")).repartition(3)
    h = {r.u: r.h for r in df.select("u", F.xxhash64("u").alias("h")).distinct().collect()}
    got = {r.metric: r for r in statistics.precision_bootstrap(df, "u", reps=60, chunk=25, seed=9).collect()}
    draws = poisson(np.array([h[r[0]] for r in rows])[:, None], 9, np.arange(60))
    y = [r[1] for r in rows]
    reps = [[precision([r[c] for r in rows], y, draws[:, k]) for k in range(60)] for c in (2, 3)]
    one = [precision([r[c] for r in rows], y, np.ones(len(rows))) for c in (2, 3)]
    want = {"average_precision_a": (one[0], reps[0]), "average_precision_b": (one[1], reps[1]), "average_precision_diff": (one[0] - one[1], [p - q for p, q in zip(*reps)])}
    for name, (point, all_) in want.items():
        low, high = np.percentile(all_, [2.5, 97.5])
        assert np.allclose([got[name].estimate, got[name].low, got[name].high, got[name].below], [point, low, high, np.mean(np.array(all_) <= 0)])


def test_one_class_and_no_rows(spark):
    for rows in ([], [("a", 0, 0.5, 0.5), ("b", 0, 0.1, 0.2)]):
        got = statistics.precision_bootstrap(spark.createDataFrame(rows, "u string, y int, score_a double, score_b double"), "u", reps=5).collect()
        assert len(got) == 3 and all(r.estimate is None for r in got)


def brute_closure(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = set()
    for a in after:
        todo, seen = list(after[a]), set()
        while todo:
            b = todo.pop()
            if b not in seen:
                seen.add(b)
                todo += after.get(b, ())
        out |= {(a, b) for b in seen}
    return out


@pytest.mark.parametrize("kind", ["hub", "cycle", "random", "dense"])
def test_closure(spark, kind, monkeypatch):
    monkeypatch.setattr(graph, "HUB", 7)
    rng = random.Random(3)
    edges = {
        "hub": [(k, 0) for k in range(1, 60)] + [(0, k) for k in range(1, 60)],
        "cycle": [(k, (k + 1) % 37) for k in range(37)] + [(3, 100), (100, 101), (101, 100)],
        "random": [(rng.randrange(60), rng.randrange(60)) for _ in range(70)],
        "dense": [(a, b) for a in range(12) for b in range(12)],
    }[kind]
    got = [tuple(r) for r in graph.transitive_closure(spark.createDataFrame(edges, "src int, dst int")).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_closure(edges)
