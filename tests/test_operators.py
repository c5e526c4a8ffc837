import itertools
import math

import pytest
from pyspark.sql import functions as F

from quern.operators import evaluate, graph, models, relational, similarity, statistics


def test_components_and_closure(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 4), (7, 7), (9, 8), (8, 10), (10, 11), (None, 3)], "src long, dst long")
    got = {r.node: r.component for r in graph.connected_components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 8: 8, 9: 8, 10: 8, 11: 8}
    assert graph.connected_components(e.limit(0)).collect() == []
    pairs = {tuple(r) for r in graph.transitive_closure(e).collect()}
    assert {(a, b) for a, b in itertools.product((1, 2, 3), repeat=2)} <= pairs and (9, 11) in pairs and (11, 9) not in pairs


def test_long_path_is_one_component(spark):
    e = spark.range(60).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r.component for r in graph.connected_components(e).collect()} == {0}


@pytest.mark.parametrize("threshold", [0.75, 0.85, 0.90])
def test_banding_finds_every_pair(spark, threshold):
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**40, (6, 128))
    rows = []
    for k in range(60):
        v = base[k % 6].copy()
        cut = rng.integers(0, 45)
        v[rng.permutation(128)[:cut]] = rng.integers(0, 2**40, cut)
        rows.append((k, v.tolist()))
    sig = spark.createDataFrame(rows, "id long, sig array<long>")
    want = {(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if sum(i == j for i, j in zip(x, y)) >= threshold * 128}
    assert {(r.a, r.b) for r in similarity.similar_pairs(sig, "id", "sig", threshold).collect()} == want


def test_families_do_not_depend_on_order_and_grow_with_the_threshold(spark):
    texts = [(k, " ".join(f"t{(k % 4) * 100 + j + (7 if j < k // 4 else 0)}" for j in range(40))) for k in range(16)]
    df = spark.createDataFrame(texts, "id long, t string").select("id", F.split("t", " ").alias("ops"))
    sig = similarity.materialize(similarity.token_signature(df, "id", F.col("ops")), "sig")
    a = {r.id: r.family for r in similarity.families(sig, "id", "sig", 0.85).collect()}
    b = {r.id: r.family for r in similarity.families(sig.orderBy(F.desc("id")), "id", "sig", 0.85).collect()}
    low = {r.id: r.family for r in similarity.families(sig, "id", "sig", 0.75).collect()}
    assert a == b and len(set(low.values())) <= len(set(a.values())) and len(a) == 16
    named = similarity.relabel(spark.createDataFrame(list(a.items()), "id long, family long"), "id", "id").collect()
    assert min(r.family_id for r in named) == "F00001"


SIX = [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.5), (1, 0.4), (0, 0.1)]


def scored(spark, rows=SIX):
    return spark.createDataFrame(rows, "y int, score double")


def test_average_precision_is_stepwise_over_ties(spark):
    want = (1 * 1 + 2 / 3 * 1 + 3 / 5 * 1) / 3
    assert math.isclose(evaluate.average_precision(scored(spark)).first()[0], want)
    won = sum(1.0 if p > n else 0.5 if p == n else 0.0 for y, p in SIX if y for z, n in SIX if not z)
    assert math.isclose(evaluate.auroc(scored(spark)).first()[0], won / 9)


def test_single_class_gives_null(spark):
    one = scored(spark, [(1, 0.2), (1, 0.4)])
    assert evaluate.auroc(one).first()[0] is None and evaluate.average_precision(scored(spark, [(0, 0.2)])).first()[0] is None


def test_thresholds(spark):
    t = evaluate.max_f1_threshold(scored(spark)).first()
    best = max((2 * sum(y for y, s in SIX if s >= c) / (sum(s >= c for _, s in SIX) + 3), c) for _, c in SIX)
    assert (t.f1, t.threshold) == pytest.approx(best)
    f = evaluate.fpr_threshold(scored(spark), 0.0).first()
    assert f.threshold == pytest.approx(0.85) and f.fpr == 0
    assert evaluate.fpr_threshold(scored(spark, [(0, 0.9), (1, 0.1)]), 0.0).first().threshold > 0.9


def test_weighted_precision_equals_repeats(spark):
    rep = scored(spark, SIX + SIX[:3])
    w = spark.createDataFrame([(y, s, 2.0 if k < 3 else 1.0) for k, (y, s) in enumerate(SIX)], "y int, score double, w double")
    assert math.isclose(evaluate.average_precision(rep).first()[0], evaluate.average_precision(w, weight="w").first()[0])


def test_zero_rules(spark):
    r = evaluate.confusion(spark.createDataFrame([(0, 0)], "y int, pred int")).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.precision, r.recall, r.fpr, r.f1) == (0, 0, 0, 1, 0, 0, 0, 0)


def test_folds(spark):
    df = spark.createDataFrame([(f"g{k % 7}", k % 3 == 0) for k in range(60)], "g string, p boolean").withColumn("y", F.col("p").cast("int"))
    for f in (evaluate.group_folds(df, "g", 3), evaluate.stratified_group_folds(df, "g", "y", 3)):
        rows = f.collect()
        assert len({r.g for r in rows}) == len(rows) == 7 and {r.fold for r in rows} == {0, 1, 2}
    sizes = df.join(evaluate.group_folds(df, "g", 3), "g").groupBy("fold").count().collect()
    assert max(r["count"] for r in sizes) - min(r["count"] for r in sizes) <= 9


def test_models(spark):
    df = spark.createDataFrame([(float(k), float(k % 5), int(k > 30)) for k in range(60)], "a double, b double, y int")
    for kind in ("logistic", "svm"):
        s = models.score(models.fit(df, ["a", "b"], kind), df)
        assert evaluate.auroc(s).first()[0] > 0.99
    s = models.score(models.fit(df, ["a", "b"]), df)
    assert models.isotonic(s).transform(s).where("calibrated is null").isEmpty() and 0.25 <= models.temperature(s) <= 4


def test_statistics(spark):
    lo, hi = statistics.wilson(F.lit(8), F.lit(10))
    r = spark.range(1).select(lo, hi).first()
    assert r[0] == pytest.approx(0.4901625, abs=1e-6) and r[1] == pytest.approx(0.9433178, abs=1e-6)
    h = {r.k: r.adjusted for r in statistics.holm(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "k string, p double"), "k", "p").collect()}
    assert h == pytest.approx({"a": 0.03, "c": 0.06, "b": 0.06})
    same = spark.createDataFrame([("x", "u"), ("x", "u"), ("y", "v")], "a string, b string")
    assert statistics.adjusted_rand(same, "a", "b").first()[0] == 1 and statistics.cohen_kappa(same, "a", "a").first().kappa == 1


def test_bootstrap_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(f"c{k % 9}", k % 3, 1) for k in range(90)], "c string, a int, b int")
    x = statistics.clustered_bootstrap(df, "c", "a", "b", 400, 100).first()
    y = statistics.clustered_bootstrap(df.repartition(7), "c", "a", "b", 400, 100).first()
    assert tuple(x) == pytest.approx(tuple(y)) and x.low <= x.estimate <= x.high


def test_conflicts(spark):
    df = spark.createDataFrame([("h1", 0), ("h1", 1), ("h2", 1), ("h2", 1)], "h string, y int")
    good, bad = relational.quarantine(df, "h", "y")
    assert [r.h for r in good.collect()] == ["h2", "h2"] and bad.count() == 2 and relational.conflicting_groups(df, "h", "y").first().labels == "0;1"


def test_joins(spark):
    a = spark.createDataFrame([(1,), (2,)], "k long")
    twice = spark.createDataFrame([(1, "x"), (1, "y")], "k long, v string")
    with pytest.raises(ValueError):
        relational.validated_join(a, twice, ["k"])
    with pytest.raises(Exception, match="no v for a key"):
        relational.attach_or_fail(a, twice, ["k"], "v").collect()
    rules = spark.createDataFrame([("ab", 1), ("abc", 2), ("zz", 3)], "p string, r int")
    got = relational.prefix_matches(spark.createDataFrame([("abcd",), ("ab",), ("q",)], "s string"), "s", rules, "p").collect()
    assert sorted((r.s, r.r) for r in got) == [("ab", 1), ("abcd", 1), ("abcd", 2)]


def test_intervals_and_spacing(spark):
    i = spark.createDataFrame([("u", 1, 3), ("u", 3, 5), ("u", 7, 9), ("w", 1, 2)], "k string, s int, e int")
    assert sorted(map(tuple, relational.merge_intervals(i, ["k"], "s", "e").collect())) == [("u", 1, 5, 2), ("u", 7, 9, 1), ("w", 1, 2, 1)]
    s = spark.range(100).withColumn("g", F.lit("a"))
    assert relational.evenly_spaced(s, ["g"], ["id"], 10).count() == 10 and relational.sample(s, "id", 7).count() == 7
    assert relational.same_set(s, s.orderBy(F.desc("id"))) and not relational.same_set(s, s.limit(3))


def test_designators_and_rules(spark):
    codes = spark.createDataFrame([("e", "0x1", "ef0100aa", True), ("e", "0x1", "6000", False), ("b", "0x1", "6001", False), ("e", "0x2", "ef0100bb", True), ("e", "0x2", "60", False), ("e", "0x2", "61", False)], "chain string, address string, code string, is_designator boolean")
    assert {r.address: r.runtime for r in relational.resolve_designators(codes).collect()} == {"0x1": "6000", "0x2": None}
    facts = {
        "public": spark.createDataFrame([("f", "0xaa"), ("q", "0xbb")], "func string, sel string"),
        "in_function": spark.createDataFrame([("b1", "f"), ("b2", "g")], "block string, func string"),
        "call_edge": spark.createDataFrame([("b1", "g"), ("b2", "f")], "block string, func string"),
        "opcode": spark.createDataFrame([("s1", "CALL"), ("s2", "ADD"), ("s3", "DELEGATECALL")], "stmt string, op string"),
        "statement": spark.createDataFrame([("s1", "g"), ("s2", "q"), ("s3", "g")], "stmt string, func string"),
        "target": spark.createDataFrame([("s1", "transfer")], "stmt string, sig string"),
    }
    got = {r.func: (r.n_calls, r.targets) for r in relational.call_rules(facts).collect()}
    assert got == {"f": (2, ["UnkownCall", "transfer"]), "q": (0, [])}
    rel = spark.createDataFrame([("0xA", ["0xB", "0xC"])], "target string, related array<string>")
    sel = spark.createDataFrame([("0xa", ["1", "2"]), ("0xb", ["2"]), ("0xc", ["9"])], "address string, selectors array<string>")
    assert [tuple(r) for r in relational.selector_matches(rel, sel).collect()] == [("0xa", "0xb", ["2"])]


def test_donors_never_share_a_family(spark):
    pool = spark.createDataFrame([(k, f"f{k % 3}", k % 2) for k in range(40)], "sid long, family string, fold int")
    fam = {r.sid: (r.family, r.fold) for r in pool.collect()}
    rows = relational.donors(pool, pool, "family", "fold", 2).collect()
    assert len(rows) == 80 and all(fam[r.sid][0] != fam[r.donor][0] and fam[r.sid][1] == fam[r.donor][1] for r in rows)
