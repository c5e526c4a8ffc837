"""Donor pools: every donor of another family can be drawn, as often as any other."""

from collections import Counter

from pyspark.sql import functions as F

from quern.operators import relational


def table(spark, rows):
    return spark.createDataFrame(rows, "sid long, family string, fold int")


def test_draws_come_from_the_whole_pool_but_the_own_family(spark):
    pool = [(k, f"f{k % 7}" if k % 3 else "big", k % 2) for k in range(60)]
    asked = [(1000 + k, ["big", "f1", "elsewhere", None][k % 4], k % 2) for k in range(2000)] + [(1, "f1", None), (2, "f1", 9)]
    got = relational.donor_ledger(table(spark, asked), table(spark, pool), "family", "fold", 3).collect()
    info = {k: (f, x) for k, f, x in pool}
    own = {k: (f, x) for k, f, x in asked}
    per = Counter(r.sid for r in got)
    assert set(per) == {k for k, _, x in asked if x in (0, 1)} and set(per.values()) == {3}
    assert len({(r.sid, r.donor) for r in got}) == len(got)
    for r in got:
        assert info[r.donor] == (r.donor_family, r.fold) and own[r.sid][1] == r.fold and r.donor_family != own[r.sid][0]
        assert r.pool_size == sum(x == r.fold and f != own[r.sid][0] for f, x in info.values())
    drawn = Counter(r.donor for r in got if r.family == "elsewhere" or r.family is None)
    assert set(drawn) == set(info) and max(drawn.values()) < 2 * min(drawn.values())


def test_small_pools(spark):
    pool = [(1, "a", 0), (2, "a", 0), (3, "b", 0), (4, "b", 1)]
    asked = [(10, "a", 0), (11, "b", 0), (12, "c", 0), (13, "b", 1)]
    got = relational.donors(table(spark, asked), table(spark, pool), "family", "fold", 3).collect()
    assert {s: {r.donor for r in got if r.sid == s} for s in (10, 11, 12, 13)} == {10: {3}, 11: {1, 2}, 12: {1, 2, 3}, 13: set()}
    assert relational.donors(table(spark, []), table(spark, pool), "family", "fold", 3).count() == 0


def test_a_code_is_a_donor_once(spark):
    rows = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y"), (4, None)], "sid long, h string")
    assert sorted(tuple(r) for r in relational.unique_donors(rows, "sid", "h").select("sid", "h").collect()) == [(1, "x"), (2, "y")]
