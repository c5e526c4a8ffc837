"""Hashes that Spark lacks: seeded blake2b and keccak selectors."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.schemas import kind

_MASK = (1 << 64) - 1


def blake2b64(c: Column, seed: int) -> Column:
    """64 bits of blake2b salted with the seed's eight little-endian bytes, as a signed long."""
    salt = seed.to_bytes(8, "little")

    @F.pandas_udf(kind("long"))
    def of(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8, salt=salt).digest(), "little", signed=True)).astype("Int64")

    return of(c)


def anonymous_id(c: Column, secret: str) -> Column:
    """Twelve hex digits that don't tell the value."""

    @F.pandas_udf(kind("string"))
    def of(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else hashlib.blake2b(f"{secret}:{x}".encode(), digest_size=6).hexdigest())

    return of(c)


def _rotate(x: int, n: int) -> int:
    return (x << n | x >> (64 - n)) & _MASK if n else x


def _permute(lanes: list[list[int]]) -> None:
    """The Keccak-f[1600] permutation; round constants come from their shift register."""
    register = 1
    for _ in range(24):
        column = [lanes[x][0] ^ lanes[x][1] ^ lanes[x][2] ^ lanes[x][3] ^ lanes[x][4] for x in range(5)]
        for x in range(5):
            d = column[x - 1] ^ _rotate(column[(x + 1) % 5], 1)
            for y in range(5):
                lanes[x][y] ^= d
        x, y, held = 1, 0, lanes[1][0]
        for t in range(24):
            x, y = y, (2 * x + 3 * y) % 5
            held, lanes[x][y] = lanes[x][y], _rotate(held, (t + 1) * (t + 2) // 2 % 64)
        for y in range(5):
            row = [lanes[x][y] for x in range(5)]
            for x in range(5):
                lanes[x][y] = row[x] ^ (~row[(x + 1) % 5] & row[(x + 2) % 5] & _MASK)
        for j in range(7):
            register = (register << 1 ^ (register >> 7) * 0x71) % 256
            if register & 2:
                lanes[0][0] ^= 1 << ((1 << j) - 1)


def keccak256(data: bytes) -> bytes:
    rate = 136
    padded = bytearray(data + b"\x01" + b"\x00" * (-(len(data) + 1) % rate))
    padded[-1] |= 0x80
    lanes = [[0] * 5 for _ in range(5)]
    for at in range(0, len(padded), rate):
        for k in range(rate // 8):
            lanes[k % 5][k // 5] ^= int.from_bytes(padded[at + 8 * k : at + 8 * k + 8], "little")
        _permute(lanes)
    return b"".join(lanes[k % 5][k // 5].to_bytes(8, "little") for k in range(4))


def selector(signature: str) -> str:
    """Four-byte selector of a function signature."""
    return keccak256(signature.encode())[:4].hex()
