import random

import pytest
from pyspark.sql import functions as F

from quern.functions import bytecode, features, opcodes
from quern.functions.cfg import analyse, control_flow, merge_ranges


def one(spark, value, *columns, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(*columns).first()


@pytest.mark.parametrize("raw, want", [(None, ""), ("", ""), ("0x", ""), ("0xABC", "ab"), (" 0x6080 ", "6080"), ("6080", "6080")])
def test_normalize(spark, raw, want):
    assert one(spark, raw, bytecode.normalize(F.col("c")))[0] == want


def test_two_normalizers_differ(spark):
    r = one(spark, "0x60zz80", bytecode.normalize(F.col("c")).alias("a"), bytecode.normalize_hex(F.col("c")).alias("b"), bytecode.to_bytes(F.col("c")).alias("d"))
    assert (r.a, r.b, bytes(r.d)) == ("60zz80", "6080", b"\x60\x80")


@pytest.mark.parametrize(
    "raw, want", [(None, "FETCH_FAIL"), ("0x", "EOA_OR_EMPTY"), ("0xef0100" + "ab" * 20, "DESIGNATOR_7702"), ("0x6080", "CONTRACT_CODE"), ("ef0100" + "ab" * 19, "CONTRACT_CODE")]
)
def test_classify(spark, raw, want):
    assert one(spark, raw, bytecode.classify_code(F.col("c")))[0] == want


def test_designators(spark):
    good, bad = "ef0100" + "ab" * 20, "ef0100" + "zz" * 20
    cols = [bytecode.is_pointer(F.col("c")), bytecode.is_designator(F.col("c")), bytecode.designator_target(F.col("c"))]
    assert tuple(one(spark, good, *cols)) == (True, True, "0x" + "ab" * 20) and tuple(one(spark, bad, *cols)) == (True, False, None)


def test_trailers(spark):
    r = one(spark, "00a201020003", bytecode.metadata_split(F.col("c")).alias("a"), bytecode.metadata_split_strict(F.col("c")).alias("b"))
    assert tuple(r.a) == tuple(r.b) == ("00", "a201020003")
    r = one(spark, "a2010003", bytecode.metadata_split(F.col("c")).alias("a"), bytecode.metadata_split_strict(F.col("c")).alias("b"))
    assert r.b.trailer == "" and one(spark, "6000", bytecode.metadata_split(F.col("c")).alias("a")).a.trailer == ""


def test_sizes_and_checks(spark):
    r = one(spark, "6080", bytecode.code_bytes(F.col("c")), bytecode.valid_input(F.col("c")), bytecode.truncated_cap(F.col("c")), bytecode.hex_number(F.col("c")).cast("long"))
    assert tuple(r) == (2, True, False, 0x6080)
    assert not one(spark, "60g0", bytecode.valid_input(F.col("c")))[0] and one(spark, "a" * 32767, bytecode.truncated_cap(F.col("c")))[0]
    assert one(spark, "ff" * 15, bytecode.hex_number(F.col("c")).cast("string"))[0] == str(int("ff" * 15, 16))


def test_vocabulary():
    v = opcodes.vocabulary()
    assert len(v) == 225 and len(set(v)) == 225 and v[0] == "STOP" and v.count("PUSH") == 1 and "PUSH0" in v


@pytest.mark.parametrize(
    "code, want",
    [("63a9059cbb55f100", (["PUSH", "SSTORE", "CALL", "STOP"], [4], ["a9059cbb"])), ("73aabb", (["PUSH"], [20], [])), ("63aabb", (["PUSH"], [4], [])), ("5f0c", (["PUSH0", "UNK_0c"], [], [])), ("", ([], [], []))],
)
def test_disassemble(spark, code, want):
    r = spark.createDataFrame([(bytearray.fromhex(code),)], "c binary").select(bytecode.disassemble("c").alias("d")).first().d
    assert (list(r.ops), list(r.push_sizes), list(r.selectors)) == want


def test_instructions_round_trip(spark):
    df = spark.createDataFrame([(1, bytearray.fromhex("600456005b00")), (2, bytearray()), (3, bytearray.fromhex("73aabb"))], "id long, code binary")
    instr = bytecode.instructions(df, "id", "code").cache()
    assert [tuple(r) for r in instr.where("id = 1").orderBy("pos").select("pc", "token", "immediate").collect()] == [(0, "PUSH", "04"), (2, "JUMP", None), (3, "STOP", None), (4, "JUMPDEST", None), (5, "STOP", None)]
    assert {r.id: r.hex for r in bytecode.assemble(instr, "id").collect()} == {1: "600456005b00", 3: "73aabb"}
    assert {r.id: (r.stack_balance, r.gas) for r in bytecode.stack_and_gas(instr, "id").collect()} == {1: (0, 12), 3: (1, 3)}
    totals = {r.id: tuple(r.t) for r in df.select("id", bytecode.program_totals("code").alias("t")).collect()}
    assert totals == {1: (5, 0, 12), 2: (0, 0, 0), 3: (1, 1, 3)}


@pytest.mark.parametrize(
    "code, want",
    [
        ("005b00", {"reachable_after_stop": False, "removed_bytes": 2, "compact": "00"}),
        ("600456005b00", {"reachable_after_stop": True, "removed_bytes": 1, "masked": "600456005b00"}),
        ("3556005b00", {"unresolved_jumps": 1, "reachable_after_stop": True}),
        ("38005b00", {"introspects": True, "removed_bytes": 0}),
        ("00a201020003", {"executable_bytes": 1, "trailer": "a201020003", "compact": "00"}),
    ],
)
def test_control_flow(spark, code, want):
    got = analyse(bytes.fromhex(code))
    assert {k: got[k] for k in want} == want
    row = spark.createDataFrame([(bytearray.fromhex(code),), (None,)], "c binary").select(control_flow("c").alias("r")).collect()
    assert {k: row[0].r[k] for k in want} == want and row[1].r.blocks == 0


def test_unreachable_bytes_do_not_change_the_compact_form():
    body = bytes.fromhex("600456005b00")
    assert analyse(body + bytes.fromhex("6001600201"))["compact"] == analyse(body)["compact"]


def test_merge_ranges():
    assert merge_ranges([(5, 6), (0, 2), (2, 3), (1, 2)]) == [(0, 3), (5, 6)] and merge_ranges([]) == []


def test_first_stop(spark):
    r = spark.createDataFrame([(bytearray.fromhex("600160020055"),), (bytearray.fromhex("6001"),)], "c binary").select(bytecode.first_stop("c").alias("r")).collect()
    assert (r[0].r.stop_offset, r[0].r.prefix, r[0].r.whole) == (4, "6001600200", False) and (r[1].r.stop_offset, r[1].r.whole) == (None, True)


def test_feature_columns(spark):
    df = spark.createDataFrame([(1, ["PUSH", "SSTORE", "CALL", "STOP"], [4], ["a9059cbb"]), (2, [], [], [])], "id long, ops array<string>, p array<int>, s array<string>")
    r = {x.id: x for x in df.select("id", features.risk_factors(F.col("ops"), F.col("s")).alias("f"), features.kgrams(F.col("ops")).alias("g"), features.structural(F.col("ops"), F.col("p"), F.col("s"), F.lit(8)).alias("t")).collect()}
    assert tuple(r[1].f) == (True, True, False, True, False, False) and tuple(r[2].f) == (False,) * 6
    assert r[1].g == ["PUSH SSTORE CALL STOP"] and r[2].g == ["<EMPTY>"] and r[1].t.n_call_family == 1 and r[2].t.call_density == 0.0
    assert tuple(r[1].t.asDict()) == features.STRUCTURAL and len(features.STRUCTURAL) == 36 and (r[1].t.n_push4, r[1].t.has_transfer, r[1].t.has_owner) == (1, 1, 0)
    v = {x.id: x.vector for x in features.histogram_vector(df, "id", "ops", opcodes.vocabulary()).collect()}
    assert len(v[1]) == 225 and abs(sum(v[1]) - 1) < 1e-12 and sum(v[2]) == 0


def test_sequences(spark):
    ids = F.sequence(F.lit(1), F.lit(10))
    r = spark.range(1).select(features.chunked(ids, 4).alias("a"), features.chunked(ids, 4, 2).alias("b"), features.downsample(ids, 5).alias("c"), features.encode_tokens(F.array(F.lit("ADD"), F.lit("?")), ("STOP", "ADD")).alias("d"), F.size(features.image(F.lit("ff00"), 2)).alias("e")).first()
    assert r.a == [[1, 2, 3, 4], [5, 6, 7, 8], [9, 10, 0, 0]] and r.b == [[1, 2, 3, 4], [9, 10, 0, 0]] and r.c == [1, 3, 5, 7, 9] and r.d == [3, 1] and r.e == 12


def test_interleaved_and_images(spark):
    rows = [(1, 0, "PUSH1", "04", 3), (1, 1, "JUMP", None, 8), (2, 0, "STOP", None, 0)]
    df = spark.createDataFrame(rows, "c long, pos int, Opcode string, Operand string, Gas int")
    got = {r.c: r.tokens for r in features.interleaved(df, "c", "pos", "Opcode", "Operand", 4).collect()}
    assert got == {1: ["PUSH1", "04", "JUMP", "<PAD>"], 2: ["STOP", "<PAD>", "<PAD>", "<PAD>"]}
    assert features.lookup_image(df, "c", "pos", ["Opcode", "Operand", "Gas"], 2).count() == 3
    assert features.count_matrix(df, "c", "Opcode", ["STOP", "JUMP", "PUSH1"]).columns == ["c", "JUMP", "PUSH1", "STOP"]


def test_hex_of_any_length_as_decimal_text(spark):
    rng = random.Random(1)
    texts = ["0", "0x0", "000", "1", "F" * 64, "0x" + "f" * 64, "8" + "0" * 63, "ab" * 100, *["".join(rng.choice("0123456789abcdef") for _ in range(n)) for n in range(1, 70)]]
    rows = spark.createDataFrame([(t,) for t in [*texts, "", "0x", "xyz", None]], "c string")
    got = {r.c: r.n for r in rows.select("c", bytecode.hex_decimal(F.col("c")).alias("n")).collect()}
    assert got == {t: str(int(t, 16)) for t in texts} | {"": None, "0x": None, "xyz": None, None: None}
