import hashlib

from pyspark.sql import functions as F

from quern.functions import bytecode, hashing
from quern.operators import programs


def test_keccak():
    assert hashing.keccak256(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert hashing.selector("transfer(address,uint256)") == "a9059cbb" and hashing.selector("approve(address,uint256)") == "095ea7b3"
    assert len(hashing.keccak256(b"x" * 500)) == 32


def test_blake(spark):
    r = spark.createDataFrame([("a",), (None,)], "c string").select(hashing.blake2b64(F.col("c"), 2).alias("h"), hashing.anonymous_id(F.col("c"), "s").alias("i")).collect()
    want = hashlib.blake2b(b"a", digest_size=8, salt=(2).to_bytes(8, "little")).digest()
    assert r[0].h == int.from_bytes(want, "little", signed=True) and len(r[0].i) == 12 and r[1].h is None and r[1].i is None


def test_instruction_tables(spark):
    df = spark.createDataFrame([(1, bytearray.fromhex("600456005b00")), (2, bytearray.fromhex("63aabb"))], "id long, code binary")
    instr = bytecode.instructions(df, "id", "code").cache()
    assert programs.with_addresses(instr.drop("pc"), "id").select("id", "pos", "pc").exceptAll(instr.select("id", "pos", "pc")).isEmpty()
    assert sorted(map(tuple, programs.push_positions(instr, "id").collect())) == [(1, 0, 1, 1, 2), (2, 0, 4, 1, 3)]
    assert [r.block for r in programs.block_numbers(instr, "id").where("id = 1").orderBy("pos").collect()] == [0, 0, 1, 2, 2]
    assert [tuple(r) for r in programs.direct_jumps(instr, "id").collect()] == [(1, 2, 4)]


def test_row_operators(spark):
    t = spark.range(1).select(programs.terminal_statistics(F.lit(3), F.lit(10)).alias("a"), programs.terminal_statistics(F.lit(None).cast("int"), F.lit(10)).alias("b"), programs.explanations({"x": F.lit(True), "y": F.lit(False), "z": F.lit(None).cast("boolean")}).alias("c")).first()
    assert (t.a.trailing_bytes, t.a.trailing_share, t.a.has_trailing, t.a.no_stop) == (6, 0.6, True, False) and (t.b.trailing_bytes, t.b.no_stop) == (0, True) and t.c == ["x"]
    p = spark.createDataFrame([("p", "eth", 5), ("p", "nft", 2), ("q", "eth", 1)], "profile string, asset string, amount long")
    c = spark.createDataFrame([("drain", "eth"), ("steal", "nft")], "capability string, asset string")
    assert sorted(map(tuple, programs.loss_table(p, c).collect())) == [("p", "drain", 5), ("p", "steal", 2), ("q", "drain", 1), ("q", "steal", 0)]
    a, b = spark.createDataFrame([("f1", "h1"), ("f2", "h2")], "f string, h string"), spark.createDataFrame([("f1", "h3")], "f string, h string")
    assert {r.key: r.shared for r in programs.leakage(a, b, ["f", "h"]).collect()} == {"f": 1, "h": 0}
    d = spark.createDataFrame([(float(k), k % 2) for k in range(40)], "a double, y int")
    assert programs.shortcut_diagnostics(d, d, {"only_a": ["a"]}).first().auroc is not None
    assert programs.one_hot(a, "f", ["f1"]).agg(F.sum("f_f1")).first()[0] == 1
    e = spark.createDataFrame([(1, True), (0, False)], "e int, s boolean")
    assert programs.error_concentration(e, "e", "s").first().ratio == 2.0


def test_featurize_and_views(spark):
    from collections import Counter

    from quern.functions import features, opcodes

    codes = ["0x63a9059cbb600456005b00f1", "", "ef0100" + "ab" * 20, None]
    vocab = opcodes.vocabulary()
    rows = {r.id: r for r in features.featurize(spark.createDataFrame(list(enumerate(codes)), "id int, c string"), "id", "c", vocab).collect()}
    views = features.feature_views(vocab)
    assert len(views["struct"]) == 36 and len(rows[0].dense) == len(vocab) + 36 == len(views["dense"]) and len(rows[0].ngram) == 512
    ops = ["PUSH", "PUSH", "JUMP", "STOP", "JUMPDEST", "STOP", "CALL"]
    assert {vocab[k]: round(x * 7) for k, x in enumerate(rows[0].dense[: len(vocab)]) if x} == Counter(ops)
    struct = dict(zip(features.STRUCTURAL, rows[0].dense[len(vocab) :]))
    assert (struct["code_bytes"], struct["n_push4"], struct["has_transfer"], struct["n_sensitive_selectors"], struct["mean_push_size"]) == (12, 1, 1, 1, 2.5)
    grams = {" ".join(ops[i : i + 4]) for i in range(4)}
    want = Counter(int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8, salt=(2).to_bytes(8, "little")).digest(), "little") % 512 for g in grams)
    assert {k: round(x * 4) for k, x in enumerate(rows[0].ngram) if x} == want
    assert not any(rows[1].dense) and not any(rows[1].ngram) and not any(rows[3].dense) and rows[2].dense[len(vocab) + 3] == 1.0
    got = spark.createDataFrame([([5.0, 6.0, 7.0],)], "v array<double>").select(features.view(F.col("v"), [2, 0]).alias("x")).first().x
    assert got == [7.0, 5.0]


def test_collate(spark):
    from quern.functions import features

    df = spark.createDataFrame([(1, [[1, 2], [3, 4]]), (2, [[5, 6]]), (3, [[7, 8]])], "id int, chunks array<array<int>>")
    got = {r.id: (r.chunks, r.chunk_mask) for r in features.collate(df, "chunks", F.floor(F.col("id") / 3)).collect()}
    assert got == {1: ([[1, 2], [3, 4]], [True, True]), 2: ([[5, 6], [0, 0]], [True, False]), 3: ([[7, 8]], [True])}


def test_projection_and_finite(spark):
    from quern.operators import relational

    df = spark.createDataFrame([("a", 1.0), ("z", float("nan")), (None, float("inf")), ("b", None)], "k string, v double")
    out = relational.projection(df, "k", {"a": (1, "x"), "b": (2, "y")}, ["n", "t"])
    assert sorted(((r.k, r.n, r.t) for r in out.collect()), key=str) == sorted([("a", 1, "x"), ("z", None, None), (None, None, None), ("b", 2, "y")], key=str)
    assert [r.k for r in relational.finite(df, "v").collect()] == ["a"]
