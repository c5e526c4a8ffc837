"""Scalar functions on hex bytecode. All stay in the JVM but for the decoders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import opcodes
from quern.schemas import struct

_CBOR = ("a2646970667358", "a165627a7a72305820")  # Fixed values: metadata markers.


def _text(c: Column) -> Column:
    """Lower case without white space at the ends and 0x; null becomes empty."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"^\s+|\s+$", ""), "^0x", "")


def normalize(c: Column) -> Column:
    """Lower case, trimmed, without 0x and without an odd last nibble; null becomes empty."""
    h = _text(c)
    return F.substring(h, F.lit(1), F.length(h) - F.length(h) % 2)


def normalize_hex(c: Column) -> Column:
    """As ``normalize``, but characters that aren't hex go before the parity cut."""
    h = F.regexp_replace(_text(c), "[^0-9a-f]", "")
    return F.substring(h, F.lit(1), F.length(h) - F.length(h) % 2)


def to_bytes(c: Column) -> Column:
    """Bytes of hex text; where it isn't hex, of its hex characters."""
    return F.coalesce(F.try_to_binary(c, F.lit("hex")), F.unhex(normalize_hex(c)))


def is_pointer(h: Column) -> Column:
    """A delegation pointer: prefix and length alone."""
    return h.startswith("ef0100") & (F.length(h) == 46)


def is_designator(h: Column) -> Column:
    """A delegation designator in which every character is hex."""
    return h.rlike("^ef0100[0-9a-f]{40}$")


def designator_target(h: Column) -> Column:
    return F.when(is_designator(h), F.concat(F.lit("0x"), F.substring(h, 7, 40)))


def classify_code(c: Column) -> Column:
    """FETCH_FAIL for null, EOA_OR_EMPTY, DESIGNATOR_7702 or CONTRACT_CODE."""
    h = normalize(c)
    return F.when(c.isNull(), "FETCH_FAIL").when(h == "", "EOA_OR_EMPTY").when(is_pointer(h), "DESIGNATOR_7702").otherwise("CONTRACT_CODE")


def code_bytes(h: Column) -> Column:
    return F.floor(F.length(h) / 2).cast("int")


def _trailer(h: Column) -> tuple[Column, Column, Column]:
    n = code_bytes(h)
    size = F.conv(F.right(h, F.lit(4)), 16, 10).cast("int")
    start = n - 2 - size
    return n, size, start


def metadata_split(h: Column) -> Column:
    """(body, trailer): the last two bytes give the trailer's length and it starts with a2."""
    n, size, start = _trailer(h)
    ok = (n >= 2) & (size > 0) & (start >= 0) & (F.substring(h, start * 2 + 1, F.lit(2)) == "a2")
    return F.when(ok, F.struct(F.substring(h, F.lit(1), start * 2).alias("body"), F.substring(h, start * 2 + 1, F.length(h)).alias("trailer"))).otherwise(F.struct(h.alias("body"), F.lit("").alias("trailer")))


def metadata_split_strict(h: Column) -> Column:
    """As ``metadata_split``, but the trailer must start before the length, in a program of four bytes or more."""
    n, size, start = _trailer(h)
    ok = (n >= 4) & (size > 0) & (start >= 0) & (start < n - 2) & (F.substring(h, start * 2 + 1, F.lit(2)) == "a2")
    return F.when(ok, F.struct(F.substring(h, F.lit(1), start * 2).alias("body"), F.substring(h, start * 2 + 1, F.length(h)).alias("trailer"))).otherwise(F.struct(h.alias("body"), F.lit("").alias("trailer")))


def has_metadata(h: Column) -> Column:
    tail = F.right(h, F.lit(300))
    return tail.contains(_CBOR[0]) | tail.contains(_CBOR[1])


def code_hash(h: Column) -> Column:
    """sha256 of the hex text, not of the bytes."""
    return F.sha2(h, 256)


def group_id(h: Column) -> Column:
    return F.concat(F.lit("B"), F.substring(code_hash(h), 1, 16))


def truncated_cap(h: Column) -> Column:
    """Text that a spreadsheet cell cut at its limit."""
    return F.length(h) == 32767


def repair_status(stored: Column, fetched: Column) -> Column:
    """What a re-fetch says about a stored prefix."""
    return F.when(fetched.isNull(), "fetch_failed").when(fetched == "", "empty").when(fetched == stored, "unchanged").when(fetched.startswith(stored), "repaired").otherwise("mismatch")


def valid_input(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.lower(c), "^0x", "").rlike("^([0-9a-f]{2})+$"), F.lit(False))


def sid(chain: Column, address: Column) -> Column:
    return F.concat_ws(":", chain, F.lower(address))


def hex_number(c: Column) -> Column:
    """Hex to decimal(38,0) by two halves; null beyond 30 digits."""
    h = F.lpad(F.regexp_replace(F.lower(c), "^0x", ""), 30, "0")
    half = lambda x: F.conv(x, 16, 10).cast("decimal(38,0)")
    return F.when(F.length(F.regexp_replace(c, "^0x", "")) <= 30, half(F.substring(h, 1, 15)) * F.lit(16**15) + half(F.substring(h, 16, 15)))


def hex_decimal(c: Column) -> Column:
    """Hex digits of any number, with or without 0x, as the text of the decimal number; null if there is none or another sign.

    Seven digits are taken at a time into limbs of nine decimal digits.
    """
    h = F.regexp_replace(F.lower(c), "^0x", "")
    parts = F.ceil(F.length(h) / 7).cast("int")
    full = F.lpad(h, parts * 7, "0")
    digits = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.conv(F.substring(full, i * 7 + 1, F.lit(7)), 16, 10).cast("long"))
    empty = F.array().cast("array<bigint>")

    def carried(s: Column, v: Column) -> Column:
        low = v % 10**9
        return F.struct(F.round((v - low) / 10**9).cast("long").alias("carry"), F.array_append(s["out"], low).alias("out"))

    def times(limbs: Column, x: Column) -> Column:
        return F.aggregate(limbs, F.struct(x.alias("carry"), empty.alias("out")), lambda s, limb: carried(s, limb * 16**7 + s["carry"]), lambda s: s["out"])

    limbs = F.aggregate(digits, F.array_repeat(F.lit(0).cast("long"), F.ceil(F.length(h) * 0.134).cast("int") + 1), times)
    text = F.array_join(F.transform(F.reverse(limbs), lambda x: F.lpad(x.cast("string"), 9, "0")), "")
    text = F.regexp_replace(text, "^0+(?=.)", "")
    return F.when(h.rlike("^[0-9a-f]+$"), text)


def hex_chunks(h: Column, width: int, length: int) -> Column:
    """Non-overlapping chunks, the remainder dropped, filled up to ``length`` with zeros."""
    parts = F.slice(F.regexp_extract_all(h, F.lit(f"(.{{{width}}})"), F.lit(1)), 1, length)
    return F.concat(parts, F.array_repeat(F.lit("0" * width), F.lit(length) - F.size(parts)))


def _tokens() -> list[str]:
    names = opcodes.table()
    return ["PUSH" if 0x60 <= b <= 0x7F else names[b][0] if b in names else f"UNK_{b:02x}" for b in range(256)]


def hex_tokens(h: Column) -> Column:
    """Two hex digits for each byte of a valid hex text; null for any other."""
    body = F.regexp_replace(F.lower(h), "^0x", "")
    return F.when(body.rlike("^([0-9a-f]{2})*$"), F.regexp_extract_all(body, F.lit("(..)"), F.lit(1)))


_TOKEN = _tokens()
_STEP = [b - 0x5E if 0x60 <= b <= 0x7F else 1 for b in range(256)]


def _starts(code: bytes) -> list[int]:
    """Where instructions begin in a linear sweep."""
    out, pc, n = [], 0, len(code)
    while pc < n:
        out.append(pc)
        pc += _STEP[code[pc]]
    return out


def _decode(code: bytes) -> list[tuple[int, int, int, str, str | None]]:
    """(pc, size, byte, token, immediate) of a linear sweep; a cut PUSH keeps what there is."""
    out = []
    for pc in _starts(code):
        b = code[pc]
        imm = code[pc + 1 : pc + _STEP[b]]
        out.append((pc, 1 + len(imm), b, _TOKEN[b], imm.hex() if _STEP[b] > 1 else None))
    return out


def decode(code: bytes | None) -> list[tuple[int, int, int, str, str | None]]:
    """(pc, size, byte, token, immediate) of a linear sweep; none for null."""
    return _decode(bytes(code)) if code is not None else []


@F.pandas_udf(struct("ops [string], push_sizes [int], selectors [string]"))
def disassemble(code: pd.Series) -> pd.DataFrame:
    """Tokens, PUSH sizes and four-byte selectors of a byte string.

    A selector is a whole PUSH4 immediate. One struct holds all three, so a
    program is decoded once.
    """
    rows = []
    for c in code:
        raw = bytes(c) if c is not None else b""
        starts = _starts(raw)
        pushes = [pc for pc in starts if _STEP[raw[pc]] > 1]
        found = {raw[pc + 1 : pc + 5].hex() for pc in pushes if raw[pc] == 0x63 and pc + 5 <= len(raw)}
        rows.append(([_TOKEN[raw[pc]] for pc in starts], [_STEP[raw[pc]] - 1 for pc in pushes], sorted(found)))
    return pd.DataFrame(rows, columns=["ops", "push_sizes", "selectors"])


@F.pandas_udf(struct("n_ops int, stack_balance int, gas int"))
def program_totals(code: pd.Series) -> pd.DataFrame:
    """Instructions, net stack effect and gas of a byte string, without a row per instruction."""
    names = opcodes.table()
    effect = np.array([(1, names[b][2] - names[b][1], names[b][3]) if b in names else (1, 0, 0) for b in range(256)])
    rows = []
    for c in code:
        raw = bytes(c) if c is not None else b""
        rows.append(np.bincount(np.frombuffer(raw, np.uint8)[_starts(raw)], minlength=256) @ effect if raw else np.zeros(3, int))
    return pd.DataFrame(np.array(rows).reshape(-1, 3), columns=["n_ops", "stack_balance", "gas"]).astype("int32")


def instructions(df: DataFrame, id_col: str, code_col: str) -> DataFrame:
    """Long form: (id, pos, pc, size, code, token, immediate), one row per instruction."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(i, k, *x) for i, c in zip(pdf.iloc[:, 0], pdf.iloc[:, 1]) for k, x in enumerate(_decode(bytes(c) if c is not None else b""))]
            yield pd.DataFrame(rows, columns=["id", "pos", "pc", "size", "code", "token", "immediate"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(id_col, code_col).mapInPandas(of, f"id {kind}, pos int, pc int, size int, code int, token string, immediate string")
    return out.withColumnRenamed("id", id_col)


def stack_and_gas(instr: DataFrame, id_col: str) -> DataFrame:
    """Net stack effect and gas of each program; unknown bytes count as INVALID."""
    dim = F.broadcast(opcodes.dimension(instr.sparkSession))  # at most 256 rows
    full = instr.join(dim, "code", "left")
    return full.groupBy(id_col).agg(F.sum(F.coalesce(F.col("pushes") - F.col("pops"), F.lit(0))).alias("stack_balance"), F.sum(F.coalesce("gas", F.lit(0))).alias("gas"))


def full_rows(instr: DataFrame) -> DataFrame:
    """Instructions with their own name (PUSH4, not PUSH), what they take and put, gas and kind.

    Bytes without an instruction keep their token, take and put nothing and cost nothing.
    """
    dim = F.broadcast(opcodes.dimension(instr.sparkSession))  # at most 256 rows
    out = instr.join(dim, "code", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("pops", "pushes", "gas")}
    return out.withColumns({"name": F.coalesce("name", "token"), "category": F.coalesce("category", F.lit("unknown")), **zero}).select(*instr.columns, "name", "pops", "pushes", "gas", "category")


def assemble(instr: DataFrame, id_col: str) -> DataFrame:
    """Hex of each program from its instructions, in the order of their places."""
    part = F.concat(F.lower(F.lpad(F.hex("code"), 2, "0")), F.coalesce("immediate", F.lit("")))
    rows = F.array_sort(F.collect_list(F.struct("pos", part.alias("h"))))
    return instr.groupBy(id_col).agg(F.array_join(F.transform(rows, lambda x: x.h), "").alias("hex"))


@F.pandas_udf(struct("stop_offset int, length int, prefix string, whole boolean, near_empty boolean"))
def first_stop(code: pd.Series) -> pd.DataFrame:
    """The prefix up to and with the first halting instruction, and what it says of the program."""
    rows = []
    for c in code:
        raw = bytes(c) if c is not None else b""
        end = next((pc + size for pc, size, _, token, _ in _decode(raw) if token in opcodes.HALTS), None)
        cut = len(raw) if end is None else end
        rows.append((None if end is None else end - 1, len(raw), raw[:cut].hex(), cut == len(raw), cut <= 2))
    out = pd.DataFrame(rows, columns=["stop_offset", "length", "prefix", "whole", "near_empty"])
    return out.astype({"stop_offset": "Int32"})
