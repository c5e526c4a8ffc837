"""Shared kernels: vectorised words, shingles and batches of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.batches import bounded_batches as bounded_batches

#: Ids that may be sent to every executor; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Rows of one key that a join gives to one task, and keys at most that are dealt over several.
SPREAD_ROWS, MOST_SPREAD = 1000, 100_000
#: UTF-8 bytes handled at once by a kernel; a longer text makes a chunk alone.
CHUNK_BYTES = 1 << 20
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_ids(ids: DataFrame) -> DataFrame:
    """A table of ids, with a broadcast hint where it is small enough."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def spread_join(rows: DataFrame, table: DataFrame, on: list[str], n: str, *, counts: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """Inner (or left) join of many rows with a table of one row per key.

    ``n`` in the table tells how many rows a key has; ``counts`` has the keys
    and ``n`` alone where the table is costly to compute. Rows of a key that has more than SPREAD_ROWS are dealt
    over as many lots as that takes, each with its own copy of the table's row.
    The list of such keys is broadcast: the bound rises with the number of
    rows, so there are at most MOST_SPREAD of them.
    """
    known = table.select(*on, n) if counts is None else counts
    total = known.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    per = max(SPREAD_ROWS, -(-total // MOST_SPREAD))
    lots = F.ceil(F.col(n) / per).cast("int")
    hot = F.broadcast(known.where(F.col(n) > per).select(*on, lots.alias("__lots")))
    lot = F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("__lots")), F.lit(0)).cast("int")
    many = rows.join(hot, on, "left").withColumn("__lot", lot).drop("__lots")
    each = F.when(F.col(n) > per, F.sequence(F.lit(0), lots - 1)).otherwise(F.array(F.lit(0)))
    table = table.withColumn("__lot", F.explode(each))
    return many.join(table, [*on, "__lot"], how).drop("__lot")


def trim() -> None:
    """Give freed memory back to the system: workers live on, and their memory is the executor's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def crc_mod(col: Column, mod: int) -> Column:
    """crc32 of the value as text, modulo ``mod``."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(mod)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; works on a copy."""
    h = h ^ (h >> np.uint64(33))
    h *= _M1
    h ^= h >> np.uint64(33)
    h *= _M2
    h ^= h >> np.uint64(33)
    return h


#: Masks of the first 0 to 8 bytes of a word of memory.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base, np.uint64)
        out[:1] = 1
        return np.cumprod(out, dtype=np.uint64)


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts with about ``limit`` bytes."""
    i, size = 0, 0
    for j, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield i, j
            i, size = j, 0
        size += len(t)
    if i < len(texts):
        yield i, len(texts)


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as UTF-8; null gives empty."""
    return [b"" if t is None else t for t in column.cast(pa.large_binary()).to_pylist()]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs without ASCII white space, A-Z lowered) of several texts.

    Returns 64-bit hashes of all words, counts per text, and each word's start
    and end byte within its text. A word is hashed eight bytes at a time, so
    its hash doesn't depend on where it stands.
    """
    low = (b"\n".join(texts) + b"\n" + bytes(8)).lower()
    size = len(low) - 8
    gap = _SPACE[np.frombuffer(low, np.uint8, size)]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    length = end - start
    eight = np.ndarray(size, "<u8", low, strides=(1,))  # the eight bytes from each place on
    with np.errstate(over="ignore"):
        h = mix((eight[start] & _LOW[np.minimum(length, 8)]) + length.astype(np.uint64) * _BASE)
        at, more = 8, np.flatnonzero(length > 8)
        while len(more):
            h[more] = mix(h[more] * _M2 + (eight[start[more] + at] & _LOW[np.minimum(length[more] - at, 8)]))
            at += 8
            more = more[length[more] > at]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    cut = np.searchsorted(start, begin)
    counts = np.diff(cut)
    own = np.repeat(begin[:-1], counts)
    return h, counts, start - own, end - own


def shingle_hashes(h: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width``-word shingles of each text and how many it has.

    A text with fewer words, but some, has one shingle: its whole sequence.
    """
    ends = np.cumsum(counts)
    n = np.maximum(counts - width + 1, np.minimum(counts, 1))
    with np.errstate(over="ignore"):
        if len(h) >= width:
            full = np.zeros(len(h) - width + 1, np.uint64)
            for k in range(width):
                full = full * _M2 + h[k : len(h) - width + 1 + k]
            full = mix(full)
        else:
            full = np.zeros(0, np.uint64)
        out = np.empty(int(n.sum()), np.uint64)
        at = np.concatenate([[0], np.cumsum(n)])
        long = counts >= width
        if len(full):
            pos = np.arange(len(h)) - np.repeat(ends - counts, counts)
            left = np.repeat(counts, counts) - pos
            keep = np.flatnonzero((left >= width))
            out[np.repeat(long, n)] = full[keep]
        for k in np.flatnonzero(~long & (counts > 0)):
            x = np.uint64(counts[k])
            for v in h[ends[k] - counts[k] : ends[k]]:
                x = x * _M2 + v
            out[at[k]] = mix(np.array([x], np.uint64))[0]
    return out, n


def shingle_sets(texts: list[bytes], width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(index, sorted distinct shingle hashes) of each text."""
    for i, j in chunks(texts):
        h, counts, _, _ = word_hashes(texts[i:j])
        s, n = shingle_hashes(h, counts, width)
        at = 0
        for k, m in enumerate(n):
            yield i + k, np.unique(s[at : at + m])
            at += m


def unique_ids(df: DataFrame, column: str) -> bool:
    row = df.agg(F.count(column).alias("n"), F.count_distinct(column).alias("d"), F.count("*").alias("a")).first()
    return row.n == row.d == row.a


def summed(df: DataFrame, length: int, lots: int = 32) -> np.ndarray:
    """Sum of the int64 vectors in the one binary column of ``df``, in two rounds."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length, np.int64)
        for batch in batches:
            for v in batch.column(0):
                total += np.frombuffer(v.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    schema = "v binary"
    rows = df.repartition(lots).mapInArrow(add, schema).repartition(1).mapInArrow(add, schema).collect()  # one row
    return np.frombuffer(rows[0].v, np.int64).copy() if rows else np.zeros(length, np.int64)


def hash01(col: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the value and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(col, F.lit(seed)), 11) / F.lit(2.0**53)
