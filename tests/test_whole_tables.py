"""Operators over whole tables by ranges and blocks, against brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import bytecode, features
from quern.functions.cfg import analyse
from quern.operators import evaluate, models, ranges, relational, statistics
from quern.plans import registry


@pytest.fixture(params=["one window", "ranges"])
def way(request, monkeypatch):
    if request.param == "ranges":
        monkeypatch.setattr(ranges, "ONE_WINDOW", 0)
    return request.param


def test_running_sums_and_maxima(spark, way):
    rng = random.Random(1)
    rows = [(k, rng.choice("abc") if k % 50 else None, rng.randint(-5, 5) if k % 7 else None) for k in range(1, 400)]
    df = spark.createDataFrame(rows, "k int, g string, v int").repartition(5)
    got = {r.k: (r.s, r.m, r.n) for r in ranges.running(df, [("k", True)], {"s": ("v", "sum"), "m": ("v", "max"), "n": (F.lit(1), "sum")}, ("g",)).collect()}
    want = {}
    for g in {r[1] for r in rows}:
        own = [r for r in sorted(rows, reverse=True) if r[1] == g]
        for i, r in enumerate(own):
            seen = [x[2] for x in own[: i + 1] if x[2] is not None]
            want[r[0]] = (sum(seen) if seen else None, max(seen) if seen else None, i + 1)
    assert got == want
    assert ranges.ranked(df.limit(0), [("k", False)], "n").collect() == []


def test_metrics_by_ranges(spark, way):
    rng = random.Random(2)
    rows = [(rng.randint(0, 1), rng.randint(0, 60) / 60) for _ in range(500)]
    df = spark.createDataFrame(rows, "y int, score double").repartition(4)
    ap = tp = fp = 0
    pos = sum(y for y, _ in rows)
    points = []
    for s in sorted({s for _, s in rows}, reverse=True):
        own = [y for y, x in rows if x == s]
        tp, fp = tp + sum(own), fp + len(own) - sum(own)
        ap += tp / (tp + fp) * sum(own)
        points.append((s, fp / (len(rows) - pos)))
    assert abs(evaluate.average_precision(df).first()[0] - ap / pos) < 1e-12
    low = min(p for p in points if p[1] <= 0.3)
    nxt = max((s for s, _ in points if s < low[0]), default=None)
    r = evaluate.fpr_threshold(df, 0.3).first()
    assert (r.threshold, r.fpr) == ((low[0] + nxt) / 2, low[1])
    none = evaluate.fpr_threshold(spark.createDataFrame([(0, 1e-9)], "y int, score double"), 0.5).first()
    assert none.threshold == np.nextafter(1e-9, 1)
    p = spark.createDataFrame([(k, v) for k, v in zip("abcde", (0.01, 0.04, 0.03, 0.005, 0.5))], "k string, p double")
    assert {r.k: round(r.adjusted, 9) for r in statistics.holm(p, "k", "p").collect()} == {"d": 0.025, "a": 0.04, "c": 0.09, "b": 0.09, "e": 0.5}


def test_ranks_and_codes(spark, way):
    words = [random.Random(3).choice(["a", "b", "c", "dd", "e"]) for _ in range(200)] + ["z"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").repartition(3)
    order = [w for w, _ in sorted(Counter(words).items(), key=lambda x: (x[1], x[0]))]
    got = {r.w: r.code for r in features.frequency_ranks(df, "w").collect()}
    assert got == {w: round(k * 255 / (len(order) - 1)) for k, w in enumerate(order)}
    assert {r.w: r.code for r in features.factorize(df, ["i"], "w").collect()} == {w: k for k, w in enumerate(dict.fromkeys(words))}


@pytest.mark.parametrize("seed", range(3))
def test_folds_equal_the_greedy_deal(spark, seed, way):
    rng = random.Random(seed)
    rows = [(f"g{g:03d}", int(rng.random() < 0.3)) for g in range(120) for _ in range(rng.choice([1, 1, 1, 2, 3, 40 if g < 4 else 2]))]
    df = spark.createDataFrame(rows, "g string, y int")
    size = Counter(g for g, _ in rows)
    load, want = [0] * 5, {}
    for g in sorted(size, key=lambda g: (-size[g], g)):
        want[g] = min(range(5), key=lambda f: (load[f], f))
        load[want[g]] += size[g]
    assert {r.g: r.fold for r in evaluate.group_folds(df, "g").collect()} == want
    p = Counter(g for g, y in rows if y)
    pos, neg, want = [0] * 5, [0] * 5, {}
    for g in sorted(size, key=lambda g: (-p[g], -(size[g] - p[g]), g)):
        n = size[g] - p[g]
        want[g] = min(range(5), key=lambda f: (pos[f], neg[f], f) if p[g] else (neg[f], pos[f], f))
        pos[want[g]], neg[want[g]] = pos[want[g]] + p[g], neg[want[g]] + n
    assert {r.g: r.fold for r in evaluate.stratified_group_folds(df, "g", "y").collect()} == want


@pytest.mark.parametrize(
    "code,removed,compact",
    [
        ("005b00", 2, "00"),
        ("600456005b00", 1, "6004565b00"),
        ("3556005b00", 1, "35565b00"),
        ("38005b00", 0, "38005b00"),
        ("601056005b00", 1, "6010565b00"),  # a target that is no JUMPDEST
        ("5f565b00", 0, "5f565b00"),  # PUSH0 before a jump
        ("a201020003", 0, ""),  # nothing but a trailer
        ("00a201020003", 0, "00"),
    ],
)
def test_under_pruning(code, removed, compact):
    got = analyse(bytes.fromhex(code))
    assert (got["removed_bytes"], got["compact"]) == (removed, compact)


def test_representations():
    got = analyse(bytes.fromhex("6001005b00a201020003"))
    assert (got["stripped"], got["prefix"], got["suffix"]) == ("6001005b00", "600100", "5b00")


def test_two_digit_tokens(spark):
    df = spark.createDataFrame([("0x6001aB",), ("600",), ("zz",), ("",), (None,)], "h string")
    assert [r[0] for r in df.select(bytecode.hex_tokens(F.col("h"))).collect()] == [["60", "01", "ab"], None, None, [], None]


def test_hashed_ngrams_by_seeded_blake2b(spark):
    rng = random.Random(5)
    rows = [(k, [rng.choice("ABCD") for _ in range(k)]) for k in range(12)]
    got = {}
    for r in features.hashed_ngrams(spark.createDataFrame(rows, "id int, ops array<string>"), "id", "ops").collect():
        got.setdefault(r.id, {})[r.bucket] = r.share
    for k, ops in rows:
        grams = {" ".join(ops[i : i + 4]) for i in range(k - 3)} if k >= 4 else {" ".join(ops) if ops else "<EMPTY>"}
        n = Counter(int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8, salt=(2).to_bytes(8, "little")).digest(), "little") % 512 for g in grams)
        assert got[k] == {b: c / len(grams) for b, c in n.items()}


def test_tails_of_chi_square(spark):
    df = spark.createDataFrame([(3.841458820694124, 1), (5.991464547107979, 2), (18.307038053275146, 10), (0.0, 3), (40.0, 2)], "s double, k int")
    got = [r[0] for r in df.select(statistics.chi_square_tail("s", "k")).collect()]
    assert np.allclose(got, [0.05, 0.05, 0.05, 1.0, math.exp(-20)], rtol=1e-10)


def test_prefixes_of_every_length(spark):
    rules = spark.createDataFrame([("x" * n, n) for n in range(1, 1300)], "prefix string, n int")
    df = spark.createDataFrame([("x" * 1299,), ("xx",), ("y",), (None,)], "t string")
    got = Counter(len(r.t) for r in relational.prefix_matches(df, "t", rules, "prefix").collect())
    assert got == {1299: 1299, 2: 2}


def test_neighbours_of_every_hundredth(spark, sf, monkeypatch):
    """All ids divisible by 100 against all rows, in one block of queries and in several."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    v, ids = np.array([r.embedding for r in e], float), np.array([r.vec_id for r in e])
    want = {}
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((v - v[ids == q][0]) ** 2).sum(1))
        near = [k for k in np.lexsort((ids, d)) if ids[k] != q][:5]
        want[int(q)] = [(rank, int(ids[k]), round(float(d[k]), 9)) for rank, k in enumerate(near, 1)]
    for size in (models.QUERY_BYTES, 1000):
        monkeypatch.setattr(models, "QUERY_BYTES", size)
        got = {}
        for r in registry.queries()["nearest_neighbor"](spark, sf).collect():
            got.setdefault(r.id, []).append((r["rank"], r.neighbour, r.distance))
        assert {k: sorted(x) for k, x in got.items()} == want


def test_members_that_meet_are_dealt_over_tasks_by_their_number(spark, monkeypatch):
    from quern.operators import relational

    rows = [(g, m, s) for g in range(4) for m in range(6) for s in range(m, 30, m + 1)] + [(None, 1, 1), (1, None, 1), (1, 1, None)]
    df = spark.createDataFrame(rows, "g int, m int, s int")
    usual = sorted(relational.group_matches(df, "g", "m", "s").collect())
    monkeypatch.setattr(relational, "MEETING_ROWS", 20)
    out = relational.group_matches(df, "g", "m", "s")
    assert out.rdd.getNumPartitions() >= 20
    assert sorted(out.collect()) == usual and len(usual) == 4 * 15 - 4 * sum(not set(range(a, 30, a + 1)) & set(range(b, 30, b + 1)) for a in range(6) for b in range(a))
