"""Families by agreement against all pairs, with bands that many signatures share."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import similarity


def brute(rows, threshold):
    ids = [i for i, _ in rows]
    sig = np.array([s for _, s in rows])
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    need = -(-int(round(threshold * sig.shape[1] * 1000)) // 1000)
    for x in range(len(ids)):
        for y in np.flatnonzero((sig[x + 1 :] == sig[x]).sum(1) >= need) + x + 1:
            a, b = sorted((root(ids[x]), root(ids[int(y)])))
            parent[b] = a
    return {i: root(i) for i in ids}


def near(rng, base, most):
    s = base.copy()
    at = rng.choice(len(s), int(rng.integers(0, most)), replace=False)
    s[at] = rng.integers(0, 1 << 40, len(at))
    return s


def made(kind, n, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 40, 128)
    out = []
    for i in range(n):
        if kind == "drift":  # a chain: each differs a little from one before it
            s = near(rng, out[int(rng.integers(max(0, i - 6), i))][1] if i else base, 12)
        elif kind == "template":  # near copies of one text, and of several that share most of it
            s = near(rng, base, 40)
            s[40:60] = rng.integers(0, 3)
        elif kind == "band":  # one band is shared by all, the rest by few
            s = near(rng, out[int(rng.integers(0, i))][1], 25) if i and rng.random() < 0.3 else rng.integers(0, 1 << 40, 128)
            s[:30] = base[:30]
        else:
            s = near(rng, out[int(rng.integers(0, i))][1], 30) if i and rng.random() < 0.6 else rng.integers(0, 1 << 40, 128)
        out.append((i, s))
    return [(i, s.tolist()) for i, s in out]


@pytest.mark.parametrize("kind", ["drift", "template", "band", "plain"])
@pytest.mark.parametrize("sizes", [(8, 64, 256), (2, 4, 16)])
def test_families_equal_all_pairs(spark, kind, sizes, monkeypatch):
    for name, size in zip(("FEW", "HOT", "LOT"), sizes):
        monkeypatch.setattr(similarity, name, size)
    rows = made(kind, 220, 3)
    df = spark.createDataFrame(rows, "id long, sig array<long>")
    got = {r.id: r.family for r in similarity.families(df, "id", "sig", 0.85).collect()}
    assert got == brute(rows, 0.85)


def test_freeze_at_three_thresholds(spark):
    rows = made("plain", 120, 8)
    out = similarity.freeze(spark.createDataFrame(rows, "id long, sig array<long>"), "id", "sig").collect()
    for name, t in (("family_id_075", 0.75), ("family_id_085", 0.85), ("family_id_090", 0.9)):
        want, order = brute(rows, t), {}
        for i, _ in rows:
            order.setdefault(want[i], f"F{len(order) + 1:05d}")
        assert {r.id: r[name] for r in out} == {i: order[want[i]] for i, _ in rows}


def test_a_band_of_ten_thousand_gives_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    sig = rng.integers(0, 1 << 40, (10_000, 128))
    sig[:, :6] = 7
    sig[1:40, :] = sig[0]
    for k in range(1, 40):
        sig[k, 6 + k] = k
    seen, verify = [0], similarity._verified

    def counted(pairs, *rest):
        seen[0] += pairs.count()
        return verify(pairs, *rest)

    monkeypatch.setattr(similarity, "_verified", counted)
    df = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(sig)], "id long, sig array<long>").repartition(4)
    got = {r.family: r.n for r in similarity.families(df, "id", "sig", 0.85).groupBy("family").agg(F.count("*").alias("n")).where("n > 1").collect()}
    assert got == {0: 40} and seen[0] < 25_000


def test_no_rows_and_one_row(spark):
    for rows in ([], [(5, [1, 2, 3, 4])]):
        out = similarity.families(spark.createDataFrame(rows, "id long, sig array<long>"), "id", "sig", 0.85).collect()
        assert [(r.id, r.family) for r in out] == [(i, i) for i, _ in rows]


def test_signatures_are_salted_minima_of_blake2b(spark, monkeypatch):
    monkeypatch.setattr(similarity, "CACHED", 5)
    rows = [(1, ["PUSH", "ADD", "PUSH", "ADD", "MUL", "STOP"]), (2, ["PUSH"]), (3, []), (4, None), (5, [f"T{k % 900}" for k in range(9000)])]
    got = {r.id: r.sig for r in similarity.token_signature(spark.createDataFrame(rows, "id long, ops array<string>"), "id", F.col("ops")).collect()}

    def hashed(data, seed):
        return int.from_bytes(hashlib.blake2b(data, digest_size=8, salt=bytes([seed]) + bytes(7)).digest(), "little")

    for i, ops in rows:
        own = [" ".join(ops[j : j + 4]) for j in range(max(1, len(ops) - 3))] if ops else ["<EMPTY>"]
        h = [hashed(g.encode(), 0) for g in own]
        want = [min(x ^ hashed(p.to_bytes(4, "little"), 1) for x in h) for p in range(128)]
        assert [x % 2**64 for x in got[i]] == want


@pytest.mark.parametrize("kind", ["template", "band", "plain"])
def test_novelty_against_all_known_rows(spark, kind, monkeypatch):
    monkeypatch.setattr(similarity, "HOT", 6)
    rows = made(kind, 160, 9)
    address = lambda i: None if i % 9 == 0 else f"0x{'A' if i % 2 else 'a'}{i % 40}"
    new, known = [r for r in rows if r[0] % 4 == 0], [r for r in rows if r[0] % 4]
    df = lambda part: spark.createDataFrame([(i, address(i), s) for i, s in part] + [(-1 if part is new else -2, None, None)], "id long, address string, sig array<long>")
    got = {r.id: r for r in similarity.novelty_against(df(new), df(known), "id", "address", "sig").collect()}
    assert set(got) == {i for i, _ in new} | {-1} and got[-1]["class"] == "novel"
    held, sig = {address(i).lower() for i, _ in known if address(i)}, np.array([s for _, s in known])
    for i, s in new:
        top = (sig == np.array(s)).sum(1).max() / 128
        assert got[i].exact == (address(i) is not None and address(i).lower() in held)
        assert got[i].similarity == (top if top * 128 >= 103 else None)
        want = "exact_overlap" if got[i].exact else "near_085" if top >= 0.85 else "near_080" if top * 128 >= 103 else "novel"
        assert got[i]["class"] == want


def test_signatures_read_batches_of_bounded_bytes(spark):
    """Distinct grams are hashed for some rows at a time, and batches are bounded by bytes, not by rows alone."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.unset(key)
    try:
        similarity.token_signature(spark.createDataFrame([(1, ["a"])], "id long, ops array<string>"), "id", F.col("ops"))
        assert spark.conf.get(key, None) is not None
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    rng = np.random.default_rng(5)
    rows = [[f"t{x}" for x in rng.integers(0, 6, n)] for n in (0, 1, 3, 4, 5, 40, 2, 300)]
    flat = [t for r in rows for t in r]
    tokens = sorted(set(flat))
    which, own = similarity._distinct_grams(np.array([len(r) for r in rows]), np.array([tokens.index(t) for t in flat]), tokens, 4)
    assert [own[k] for k in which] == [" ".join(r[i : i + 4]) for r in rows for i in range(len(r) - 3)] and len(set(own)) == len(own)
