"""Bootstraps, condition grids, closures, sinks and scratch folders."""

import json
import os
import random

import numpy as np
from pyspark.sql import functions as F

from quern.operators import graph, models, similarity, statistics
from quern.plans import materialize as scratch
from quern.sources import sinks


def rows_of_models(spark, n=400, families=40):
    rng = random.Random(4)
    rows = []
    for k in range(n):
        y = int(rng.random() < 0.4)
        rows.append((k, f"f{k % families}", k % 2, y, int(rng.random() < (0.8 if y else 0.2)), int(rng.random() < (0.6 if y else 0.3)), round(rng.random() * 0.5 + 0.4 * y, 2), round(rng.random(), 2)))
    return rows, spark.createDataFrame(rows, "id long, fam string, fold int, y int, pred_a int, pred_b int, score_a double, score_b double")


def test_paired_bootstrap(spark):
    rows, df = rows_of_models(spark)
    for unit, strata in (("id", None), ("fam", None), ("fam", "fold")):
        got = {r.metric: r for r in statistics.paired_bootstrap(df, unit, reps=600, chunk=100, strata=strata).collect()}
        pos = [r for r in rows if r[3]]
        assert abs(got["recall_a"].estimate - sum(r[4] for r in pos) / len(pos)) < 1e-12
        assert all(r.low <= r.estimate <= r.high for r in got.values()) and len(got) == 6
        # the spread of a plain bootstrap over the same units
        units = {}
        for r in rows:
            units.setdefault(r[0] if unit == "id" else r[1], []).append(r)
        names, rng, plain = sorted(units), np.random.default_rng(1), []
        for _ in range(600):
            drawn = [x for k in rng.integers(0, len(names), len(names)) for x in units[names[k]]]
            p = [x for x in drawn if x[3]]
            plain.append(sum(x[4] - x[5] for x in p) / len(p))
        low, high = np.percentile(plain, [2.5, 97.5])
        d = got["recall_diff"]
        assert 0.6 < (d.high - d.low) / (high - low) < 1.6 and d.below < 0.05
    again = statistics.paired_bootstrap(df.repartition(7), "fam", reps=600, chunk=100).collect()
    assert sorted(again) == sorted(statistics.paired_bootstrap(df, "fam", reps=600, chunk=100).collect())


def test_precision_bootstrap(spark):
    rows, df = rows_of_models(spark)
    got = {r.metric: r for r in statistics.precision_bootstrap(df, "fam", reps=200, chunk=50, bins=100, strata="fold").collect()}

    def precision(at):
        tp = n = 0
        out = 0.0
        for s in sorted({min(int(r[at] * 100), 99) for r in rows}, reverse=True):
            own = [r[3] for r in rows if min(int(r[at] * 100), 99) == s]
            tp, n = tp + sum(own), n + len(own)
            out += tp / n * sum(own)
        return out / sum(r[3] for r in rows)

    assert abs(got["average_precision_a"].estimate - precision(6)) < 1e-9 and abs(got["average_precision_b"].estimate - precision(7)) < 1e-9
    assert got["average_precision_diff"].low > 0 and got["average_precision_diff"].below == 0


def test_dunn_adjusts(spark):
    rng = random.Random(5)
    rows = [(g, rng.gauss(m, 1)) for g, m in (("a", 0), ("b", 0), ("c", 3)) for _ in range(40)]
    got = {(r.a, r.b): r for r in statistics.dunn(spark.createDataFrame(rows, "g string, v double"), "v", "g").collect()}
    assert len(got) == 3 and got["a", "c"].adjusted < 1e-6 and got["a", "b"].p_value > 0.01 and all(r.adjusted >= r.p_value for r in got.values())


def test_closure_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(40, 38), (7, None)], "src int, dst int")
    got = {tuple(r) for r in graph.transitive_closure(edges).collect()}
    assert got == {(a, b) for a in range(41) for b in range(a + 1, 41)} | {(a, b) for a in (38, 39, 40) for b in (38, 39, 40)}
    assert graph.transitive_closure(edges.limit(0)).collect() == []


def test_calibrated_svm(spark):
    rng = random.Random(6)
    rows = [(float(k), rng.gauss(2 * (k % 2), 1), k % 2) for k in range(400)]
    df = spark.createDataFrame(rows, "k double, x double, y int")
    scored = models.calibrated(df.where("k < 200"), df.where("k >= 200 and k < 300"), ["x"])(df.where("k >= 300")).collect()
    assert all(0 < r.score < 1 for r in scored) and np.mean([(r.score >= 0.5) == r.y for r in scored]) > 0.75


def test_banded_pairs(spark):
    sig = spark.createDataFrame([(1, [1, 2, 3, 4, 5, 6]), (2, [1, 2, 3, 4, 5, 9]), (3, [9, 2, 3, 4, 5, 6]), (4, [1, 2, 3, 4, 5, 6])], "id long, sig array<long>")
    assert [(r.a, r.b, round(r.similarity, 3)) for r in similarity.banded_pairs(sig, "id", "sig", 0.8).collect()] == [(1, 2, 0.833)]


def test_documents_and_hex_files(spark, tmp_path):
    df = spark.createDataFrame([("eth", "0xAB", "6000"), ("eth", "0xcd", ""), (None, "0x1", "00"), ("bsc", "0xab", "ff")], "chain string, address string, code string")
    sinks.write_json_document(df.select("chain", "code"), f"file://{tmp_path}/doc")
    assert {(r.get("chain"), r["code"]) for r in sinks.read_json_document(spark, f"file://{tmp_path}/doc")} == {("eth", "6000"), ("eth", ""), (None, "00"), ("bsc", "ff")}
    for _ in range(2):
        assert sinks.write_hex_files(df, f"file://{tmp_path}/hex").count() == 3
    files = sorted(os.path.relpath(os.path.join(d, f), tmp_path / "hex") for d, _, fs in os.walk(tmp_path / "hex") for f in fs)
    assert files == ["bsc/0xab.hex", "eth/0xab.hex", "eth/0xcd.hex"] and (tmp_path / "hex/eth/0xab.hex").read_text() == "6000"
    assert json.loads(json.dumps(files)) == files


def test_passing_tables_go(spark):
    with scratch.passing(spark):
        inner = scratch.materialize(spark.range(3), "inner")
        path = inner.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
        kept = scratch.scratch_path(spark, "x")
    assert not os.path.exists(path) and "passing" in kept and "passing" not in scratch.scratch_path(spark, "x")
    assert scratch.materialize(spark.range(2).select(F.col("id")), "outer").count() == 2
