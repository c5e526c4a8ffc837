"""Token ids in patched frame-of-reference files.

A file holds the ids of consecutive documents as one stream, in blocks of 128.
A block stores its minimum, the width that fits a given percentile of the
differences to it, those differences packed at that width, and an exception
list with the places and high bits of those that need more. A footer indexes
block starts and lists document ids and lengths.

Layout, little-endian: magic | blocks | footer | footer length (8 bytes) | magic.
Block: minimum (4) width (1) exceptions (1) packed (16 * width) places (1 each)
high bits (4 each). Footer: n blocks, n docs, n tokens (8 each), block starts
(8 each), document ids (8 each), lengths (8 each).
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import bounded_batches
from quern.llm.tokens import encoder
from quern.plans.materialize import materialize, scratch_path

MAGIC, BLOCK, PERCENTILE = b"QPFOR1\n\x00", 128, 0.9
#: Ids after which a file is closed; ids decoded at once.
FILE_TOKENS, READ_BLOCKS = 4 << 20, 2048


def _pack(d: np.ndarray, w: int) -> np.ndarray:
    """Low w bits of 128 values per row, first value in the lowest bits: 16 * w bytes per row."""
    t = d.T.astype(np.uint64) & np.uint64((1 << w) - 1)
    out = np.zeros((2 * w, len(d)), np.uint64)
    for i in range(BLOCK):
        word, shift = divmod(i * w, 64)
        out[word] |= t[i] << np.uint64(shift)
        if shift + w > 64:
            out[word + 1] |= t[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).astype("<u8").view(np.uint8).reshape(len(d), 16 * w)


def _unpack(raw: np.ndarray, w: int) -> np.ndarray:
    words = np.ascontiguousarray(np.ascontiguousarray(raw).view("<u8").T)
    out = np.empty((BLOCK, len(raw)), np.uint32)
    mask = np.uint64((1 << w) - 1)
    for i in range(BLOCK):
        word, shift = divmod(i * w, 64)
        v = words[word] >> np.uint64(shift)
        if shift + w > 64:
            v = v | words[word + 1] << np.uint64(64 - shift)
        out[i] = v & mask
    return out.T


def _encode_some(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of full blocks (one per row) and the size of each."""
    low = v.min(1)
    d = v - low[:, None]
    kth = int(np.ceil(PERCENTILE * BLOCK)) - 1
    width = np.frexp(np.partition(d, kth, axis=1)[:, kth].astype(np.float64))[1].astype(np.int64)
    over = (d >> width[:, None].astype(np.uint32)) != 0
    over[width >= 32] = False
    exceptions = over.sum(1)
    size = 6 + 16 * width + 5 * exceptions
    start = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(start[-1], np.uint8)
    begin = start[:-1]
    out[begin[:, None] + np.arange(4)] = low.astype("<u4")[:, None].view(np.uint8)
    out[begin + 4], out[begin + 5] = width, exceptions
    for w in np.unique(width).tolist():
        if w:
            at = np.flatnonzero(width == w)
            out[(begin[at] + 6)[:, None] + np.arange(16 * w)] = _pack(d[at], w)
    row, place = np.nonzero(over)
    if len(row):
        nth = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        spot = begin[row] + 6 + 16 * width[row]
        out[spot + nth] = place
        high = (d[row, place] >> width[row].astype(np.uint32)).astype("<u4")
        out[(spot + exceptions[row] + 4 * nth)[:, None] + np.arange(4)] = high[:, None].view(np.uint8)
    return out, size


def encode_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Encoded blocks and the start of each; the last is filled up with its minimum."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return b"", np.zeros(0, np.int64)
    parts, sizes = [], []
    for k in range(0, n, READ_BLOCKS):
        v = ids[k * BLOCK : (k + READ_BLOCKS) * BLOCK]
        if len(v) % BLOCK:
            v = np.concatenate([v, np.full(-len(v) % BLOCK, v[len(v) // BLOCK * BLOCK :].min(), np.uint32)])
        raw, size = _encode_some(v.reshape(-1, BLOCK))
        parts.append(raw.tobytes())
        sizes.append(size)
    size = np.concatenate(sizes)
    return b"".join(parts), np.cumsum(size) - size


def decode_blocks(raw: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Ids of the blocks that start at ``begin`` in ``raw``, fill included."""
    n = len(begin)
    low = raw[begin[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
    width, exceptions = raw[begin + 4].astype(np.int64), raw[begin + 5].astype(np.int64)
    d = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(width).tolist():
        if w:
            at = np.flatnonzero(width == w)
            d[at] = _unpack(raw[(begin[at] + 6)[:, None] + np.arange(16 * w)], w)
    if exceptions.any():
        row = np.repeat(np.arange(n), exceptions)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        spot = begin[row] + 6 + 16 * width[row]
        place = raw[spot + nth]
        high = raw[(spot + exceptions[row] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
        d[row, place] |= high << width[row].astype(np.uint32)
    return (d + low[:, None]).ravel()


def encode_file(docs: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    body, begin = encode_blocks(ids)
    known = [-(2**63) if d is None else d for d in docs]
    foot = b"".join(np.array(x, "<i8").tobytes() for x in ([len(begin), len(docs), len(ids)], begin, known, lengths))
    return MAGIC + body + foot + len(foot).to_bytes(8, "little") + MAGIC


def open_file(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Body, block starts, document ids, lengths and ids of a file."""
    if raw[:8] != MAGIC or raw[-8:] != MAGIC:
        raise ValueError("not a token file")
    size = int.from_bytes(raw[-16:-8], "little")
    foot = np.frombuffer(raw[-16 - size : -16], "<i8")
    blocks, docs, tokens = foot[:3].tolist()
    rest = foot[3:]
    return np.frombuffer(raw, np.uint8)[8:], rest[:blocks], rest[blocks : blocks + docs], rest[blocks + docs :], tokens


def read_documents(raw: bytes) -> Iterator[tuple[int | None, int, bytes]]:
    """(document id, first place, ids) in order, decoding a few blocks at a time."""
    body, begin, docs, lengths, tokens = open_file(raw)
    held, at, block = b"", 0, 0
    for doc, n in zip(docs.tolist(), lengths.tolist()):
        parts = [held]
        have = len(held) // 4
        while have < n:
            some = decode_blocks(body, begin[block : block + READ_BLOCKS])
            some = some[: tokens - block * BLOCK]
            block += READ_BLOCKS
            parts.append(some.astype("<u4").tobytes())
            have += len(some)
        joined = b"".join(parts)
        yield None if doc == -(2**63) else doc, at, joined[: 4 * n]
        held, at = joined[4 * n :], at + n


def _storage(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _write(path: str, tokenizer_path: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _storage(path)
        store.create_dir(root, recursive=True)
        lot, enc = TaskContext.get().partitionId(), encoder(tokenizer_path)
        docs, lengths, parts, held, nth = [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            # a fresh name for each attempt: only the manifest says which count
            name = f"{root}/{lot:06d}-{nth:06d}-{uuid.uuid4().hex}.qpf"
            with store.open_output_stream(name) as f:
                f.write(encode_file(docs, lengths, np.frombuffer(b"".join(parts), "<u4")))
            return pa.RecordBatch.from_arrays([pa.array([lot], pa.int32()), pa.array([nth], pa.int32()), pa.array([name.rpartition("/")[2]]), pa.array([len(docs)], pa.int64()), pa.array([sum(lengths)], pa.int64())], ["lot", "nth", "name", "n_docs", "n_tokens"])

        for batch in batches:
            for d, own in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist())):
                docs.append(d), lengths.append(len(own) // 4 + 1), parts.extend((own, end))
                held += lengths[-1]
                if held >= FILE_TOKENS:
                    yield close()
                    docs, lengths, parts, held, nth = [], [], [], 0, nth + 1
        if docs:
            yield close()

    return of


def _read(path: str, with_ids: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _storage(path)
        for batch in batches:
            for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist()):
                with store.open_input_stream(f"{root}/{name}") as f:
                    raw = f.read()
                rows, size = [], 0
                for doc, at, ids in read_documents(raw):
                    rows.append((doc, base + at, len(ids) // 4, zlib.crc32(ids), ids if with_ids else None))
                    size += len(ids) * with_ids
                    if len(rows) >= 10_000 or size > 16 << 20:
                        yield _rows(rows, with_ids)
                        rows, size = [], 0
                if rows:
                    yield _rows(rows, with_ids)

    return of


def _rows(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    types = [pa.int64()] * 4 + [pa.binary()] * with_ids
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names[: len(types)])


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Write all documents' ids in ascending id order under ``path``; returns the manifest.

    The manifest (lot, nth, name, n_docs, n_tokens, base) lists the files in
    order with the number of ids before each; it is itself kept in the shared
    folder. Files of failed attempts are not in it. Null texts are empty, null
    ids come first, and repeated ids follow one another in the order of their
    texts' hashes. ``path`` must be a location that all executors share.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    tie = F.xxhash64("text")
    rows = src.repartitionByRange(F.col("id"), tie).sortWithinPartitions("id", tie)
    schema = "lot int, nth int, name string, n_docs long, n_tokens long"
    manifest = materialize(rows.mapInArrow(_write(path, tokenizer_path, end_id), schema), "manifest")
    totals = manifest.groupBy("lot").agg(F.sum("n_tokens").alias("t")).orderBy("lot").collect()  # a row for each partition
    before, at = [], 0
    for r in totals:
        before.append((r.lot, at))
        at += r.t
    lots = F.broadcast(spark.createDataFrame(before, "lot int, lot_base long"))
    own = Window.partitionBy("lot").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    manifest = manifest.withColumn("own", F.coalesce(F.sum("n_tokens").over(own), F.lit(0))).join(lots, "lot")
    return manifest.select("lot", "nth", "name", "n_docs", "n_tokens", (F.col("lot_base") + F.col("own")).alias("base"))


def read_tokens(manifest: DataFrame, path: str, *, with_ids: bool = False) -> DataFrame:
    """Documents of the manifest's files: (doc_id, start, n_tokens, ids_crc32[, ids]).

    start counts the ids of all documents before it. A file is read by one task.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    files = manifest.count()
    lots = max(1, min(files, 4 * manifest.sparkSession.sparkContext.defaultParallelism))
    return manifest.select("name", "base").repartition(lots, "name").mapInArrow(_read(path, with_ids), schema)


def op5_pfor_tokens(spark, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = scratch_path(spark, "tokens")
    manifest = write_tokens(docs, path, tokenizer_path=public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(manifest, path)
