"""Features of token sequences, as columns or as grouped plans over exploded tokens."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quern.functions.batches import bounded_batches
from quern.functions.hashing import selector
from quern.operators.ranges import ranked
from quern.plans.materialize import materialize
from quern.schemas import struct

# Token groups, and signatures whose selectors a program may hold.
CALLS = ("CALL", "STATICCALL", "DELEGATECALL", "CALLCODE")
CREATES = ("CREATE", "CREATE2")
SIGNATURES = (
    "transfer(address,uint256)",
    "transferFrom(address,address,uint256)",
    "approve(address,uint256)",
    "safeTransferFrom(address,address,uint256)",
    "withdraw(uint256)",
    "owner()",
    "execute(address,uint256,bytes)",
)
#: Selectors by signature.
SELECTORS = {s: selector(s) for s in SIGNATURES}
SENSITIVE_SELECTORS = tuple(SELECTORS.values())
MOVEMENT_SELECTORS = tuple(SELECTORS[s] for s in (SIGNATURES[0], SIGNATURES[1], SIGNATURES[3]))
APPROVAL_SELECTOR = SELECTORS[SIGNATURES[2]]


def bind(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once for each row.

    The optimizer would otherwise copy the expression into every lambda and
    place that uses it, and so compute it once per element.
    """
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def kgrams(ops: Column, k: int = 4) -> Column:
    """Distinct k-grams; a shorter sequence whole; <EMPTY> for none."""
    return bind(ops, lambda w: _kgrams(w, k))


def _kgrams(ops: Column, k: int) -> Column:
    grams = F.transform(F.sequence(F.lit(1), F.size(ops) - (k - 1)), lambda i: F.array_join(F.slice(ops, i, k), " "))
    return F.when(F.size(ops) >= k, F.array_distinct(grams)).when(F.size(ops) > 0, F.array(F.array_join(ops, " "))).otherwise(F.array(F.lit("<EMPTY>")))


def digest60(c: Column) -> Column:
    """The first 60 bits of sha256, a number that DuckDB can compute as well."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 15), 16, 10).cast("long")


def _rows_of(df: DataFrame, id_col: str, ops_col: str, fields: str, each) -> DataFrame:
    """(id, *fields): the tuples that ``each`` gives for the tokens of one row; a row's tokens stay together."""
    types = [f.dataType for f in struct(fields).fields]
    arrow = [to_arrow_type(t) for t in types]
    names = [id_col, *struct(fields).names]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, out = [], []
            for k, ops in enumerate(batch.column(1).to_pylist()):
                before = len(out)
                out.extend(each(ops))
                own.extend([k] * (len(out) - before))
                if len(out) >= 100_000:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())), *(pa.array([r[i] for r in out], t) for i, t in enumerate(arrow))], names)
                    own, out = [], []
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())), *(pa.array([r[i] for r in out], t) for i, t in enumerate(arrow))], names)

    return df.select(id_col, ops_col).mapInArrow(of, T.StructType([df.schema[id_col], *struct(fields).fields]))


def histogram(df: DataFrame, id_col: str, ops_col: str) -> DataFrame:
    """(id, op, n, share): tokens of each row and their share of its tokens."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                batch = whole.slice(first, 1000)
                lists = batch.column(1)
                n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                coded = lists.flatten().dictionary_encode()
                kinds = max(len(coded.dictionary), 1)
                own = np.repeat(np.arange(len(n)), n)
                key, count = np.unique(own * kinds + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
                row = key // kinds
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), coded.dictionary.take(pa.array(key % kinds)), pa.array(count), pa.array(count / n[row])], [id_col, "op", "n", "share"])

    return df.select(id_col, ops_col).mapInArrow(of, T.StructType([df.schema[id_col], *struct("op string, n long, share double").fields]))


def histogram_vector(df: DataFrame, id_col: str, ops_col: str, vocabulary: tuple[str, ...]) -> DataFrame:
    """(id, vector): shares in vocabulary order, zero where absent; rows without tokens get zeros."""
    h = histogram(df, id_col, ops_col).groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("op", "share"))).alias("m"))
    vector = F.transform(F.array(*map(F.lit, vocabulary)), lambda v: F.coalesce(F.col("m")[v], F.lit(0.0)))
    out = df.select(id_col).distinct().join(h, id_col, "left").withColumn("m", F.coalesce("m", F.create_map().cast("map<string,double>")))
    return out.select(id_col, vector.alias("vector"))


def count_matrix(df: DataFrame, id_col: str, op_col: str, vocabulary: list[str]) -> DataFrame:
    """One count column per token of a long table, columns in sorted order."""
    return df.groupBy(id_col).pivot(op_col, sorted(vocabulary)).count().fillna(0)


def hashed_ngrams(df: DataFrame, id_col: str, ops_col: str, buckets: int = 512, k: int = 4, seed: int = 2, digest: str = "blake2b") -> DataFrame:
    """(id, bucket, share): distinct k-grams dealt into buckets by hash, over the number of k-grams.

    A shorter sequence is one gram; none is <EMPTY>. The hash is 64 bits of
    blake2b salted with the seed's eight little-endian bytes or, where SQL has
    to repeat it, the first 60 bits of ``sha256``.
    """
    return _rows_of(df, id_col, ops_col, "bucket int, share double", lambda ops: ngram_shares(ops, buckets, k, seed, digest))


def ngram_shares(ops: list[str] | None, buckets: int = 512, k: int = 4, seed: int = 2, digest: str = "blake2b") -> list[tuple[int, float]]:
    """(bucket, share) of one sequence's distinct k-grams."""
    salt = seed.to_bytes(8, "little")

    def number(gram: str) -> int:
        if digest == "sha256":
            return int.from_bytes(hashlib.sha256(gram.encode()).digest()[:8], "big") >> 4
        return int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8, salt=salt).digest(), "little")

    if not ops:
        grams = {"<EMPTY>"}
    else:
        grams = {" ".join(g) for g in zip(*(ops[i:] for i in range(k)))} if len(ops) >= k else {" ".join(ops)}
    return [(b, n / len(grams)) for b, n in Counter(number(g) % buckets for g in grams).items()]


def _n(ops: Column, *names: str) -> Column:
    return F.size(F.filter(ops, lambda x: x.isin(*names)))


def structural(ops: Column, push_sizes: Column, selectors: Column, size: Column, pointer: Column | None = None, sensitive: tuple[str, ...] = SENSITIVE_SELECTORS) -> Column:
    """36 counts, densities and flags of a program as one struct of doubles, in a fixed order."""
    total = F.size(ops)
    pushed = lambda n: F.size(F.filter(push_sizes, lambda x: x == n))
    per = lambda c: c / F.greatest(total, F.lit(1))
    hit = F.size(F.array_intersect(selectors, F.array(*map(F.lit, sensitive)).cast("array<string>")))
    value = {
        "code_bytes": size,
        "n_ops": total,
        "n_selectors": F.size(selectors),
        "is_delegation_ptr": F.lit(False) if pointer is None else pointer,
        "n_jumpdest": _n(ops, "JUMPDEST"),
        "n_jump": _n(ops, "JUMP"),
        "n_jumpi": _n(ops, "JUMPI"),
        "n_call": _n(ops, "CALL"),
        "n_staticcall": _n(ops, "STATICCALL"),
        "n_delegatecall": _n(ops, "DELEGATECALL"),
        "n_callcode": _n(ops, "CALLCODE"),
        "n_call_family": _n(ops, *CALLS),
        "n_create": _n(ops, *CREATES),
        "n_selfdestruct": _n(ops, "SELFDESTRUCT"),
        "n_sstore": _n(ops, "SSTORE"),
        "n_sload": _n(ops, "SLOAD"),
        "n_log": _n(ops, *(f"LOG{k}" for k in range(5))),
        "n_revert": _n(ops, "REVERT"),
        "n_invalid": F.size(F.filter(ops, lambda x: x.startswith("UNK_") | (x == "INVALID"))),
        "n_push": _n(ops, "PUSH"),
        "mean_push_size": F.coalesce(F.aggregate(push_sizes, F.lit(0), lambda a, x: a + x) / F.nullif(F.size(push_sizes), F.lit(0)), F.lit(0)),
        "n_push4": pushed(4),
        "n_push20": pushed(20),
        "n_push32": pushed(32),
        "jumpdest_density": per(_n(ops, "JUMPDEST")),
        "call_density": per(_n(ops, *CALLS)),
        "push_density": per(_n(ops, "PUSH")),
        "has_sensitive_selector": hit > 0,
        "n_sensitive_selectors": hit,
        **{f"has_{s.split('(')[0]}": F.array_contains(selectors, x) for s, x in SELECTORS.items()},
    }
    return F.struct(*[v.cast("double").alias(k) for k, v in value.items()])


#: Names of the structural features, in order.
STRUCTURAL = (
    *"code_bytes n_ops n_selectors is_delegation_ptr n_jumpdest n_jump n_jumpi n_call n_staticcall n_delegatecall n_callcode n_call_family".split(),
    *"n_create n_selfdestruct n_sstore n_sload n_log n_revert n_invalid n_push mean_push_size n_push4 n_push20 n_push32".split(),
    *"jumpdest_density call_density push_density has_sensitive_selector n_sensitive_selectors".split(),
    *(f"has_{s.split('(')[0]}" for s in SIGNATURES),
)


def risk_factors(ops: Column, selectors: Column) -> Column:
    """Six observable facts about a program."""
    any_of = lambda *n: F.exists(ops, lambda x: x.isin(*n))
    moves = F.arrays_overlap(selectors, F.array(*map(F.lit, MOVEMENT_SELECTORS)))
    return F.struct(
        any_of(*CALLS).alias("external_call_surface"),
        any_of("SSTORE").alias("state_write_surface"),
        any_of("DELEGATECALL", "CALLCODE").alias("delegate_proxy_surface"),
        F.coalesce(moves, F.lit(False)).alias("token_movement_selector_surface"),
        F.coalesce(F.array_contains(selectors, APPROVAL_SELECTOR), F.lit(False)).alias("approval_selector_surface"),
        any_of(*CREATES, "SELFDESTRUCT").alias("code_lifecycle_surface"),
    )


def evidence(ops: Column, selectors: Column, size: Column) -> Column:
    """What the risk factors rest on: sizes, counts of the tokens they name, and selectors."""
    counted = (*CALLS, "SSTORE", *CREATES, "SELFDESTRUCT")
    moves = F.array_sort(F.array_intersect(selectors, F.array(*map(F.lit, MOVEMENT_SELECTORS))))
    return F.struct(
        size.alias("code_bytes"),
        F.size(ops).alias("opcode_count"),
        F.struct(*[_n(ops, n).alias(n) for n in counted]).alias("opcode_counts"),
        moves.alias("token_movement_selectors"),
        F.when(F.array_contains(selectors, APPROVAL_SELECTOR), APPROVAL_SELECTOR).alias("approval_selector"),
        risk_factors(ops, selectors).alias("observed_factors"),
    )


def featurize(programs: DataFrame, id_col: str, code_col: str, vocabulary: tuple[str, ...], buckets: int = 512, sensitive: tuple[str, ...] = SENSITIVE_SELECTORS) -> DataFrame:
    """(id, dense, ngram): token shares in vocabulary order with the structural features, and hashed 4-grams.

    Both are arrays; ``feature_views`` names parts of them. A row is a program
    of its own, so ids should differ. A program without tokens has zeros only.
    """
    from quern.functions import bytecode

    bounded_batches(programs.sparkSession)
    hexes = bytecode.normalize(F.col(code_col))
    own = programs.select(id_col, hexes.alias("h")).withColumn("d", bytecode.disassemble(bytecode.to_bytes(F.col("h"))))
    own = own.select(id_col, "h", F.col("d.ops").alias("ops"), F.col("d.push_sizes").alias("p"), F.col("d.selectors").alias("s"))
    place = {v: k for k, v in enumerate(vocabulary)}
    flat = structural(F.col("ops"), F.col("p"), F.col("s"), bytecode.code_bytes(F.col("h")), bytecode.is_pointer(F.col("h")), sensitive)
    rows = own.select(id_col, "ops", flat.alias("t")).select(id_col, "ops", F.array(*[F.col(f"t.{n}") for n in STRUCTURAL]).alias("struct"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                batch = whole.slice(first, 1000)
                n = batch.num_rows
                dense, grams = np.zeros((n, len(vocabulary) + len(STRUCTURAL))), np.zeros((n, buckets))
                dense[:, len(vocabulary) :] = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                for k, row in enumerate(batch.column(1)):  # one program's tokens as Python objects at a time
                    ops = row.as_py()
                    for op, many in Counter(ops).items():
                        if op in place:
                            dense[k, place[op]] = many / len(ops)
                    for b, x in ngram_shares(ops, buckets) if ops else ():
                        grams[k, b] = x
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64())) for x in (dense, grams)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *lists], [id_col, "dense", "ngram"])

    return rows.mapInArrow(of, T.StructType([programs.schema[id_col], *struct("dense [double], ngram [double]").fields]))


def feature_views(vocabulary: tuple[str, ...]) -> dict[str, list[int]]:
    """Places of the parts of ``dense``: hist, struct, dense, sel (selectors and calls) and length."""
    names = [*(f"op_{v}" for v in vocabulary), *STRUCTURAL]
    sel = ("n_selectors", "n_sensitive_selectors", "n_call_family", "n_delegatecall")
    return {
        "hist": list(range(len(vocabulary))),
        "struct": list(range(len(vocabulary), len(names))),
        "dense": list(range(len(names))),
        "sel": [k for k, n in enumerate(names) if n.startswith("has_") or n in sel],
        "length": [names.index("code_bytes"), names.index("n_ops")],
    }


def view(vector: Column, places: list[int]) -> Column:
    """The values at some places of an array, in their order."""
    return bind(vector, lambda v: F.transform(F.array(*map(F.lit, places)), lambda k: F.get(v, k)))


def collate(chunks: DataFrame, chunk_col: str, batch: Column) -> DataFrame:
    """Chunk lists filled up to the longest of their batch, with a mask: (*columns, batch, chunk_mask).

    An added chunk is all zeros, the padding id; the mask is true for real ones.
    """
    df = chunks.withColumn("batch", batch)
    most = df.groupBy("batch").agg(F.max(F.size(chunk_col)).alias("__most"))
    out = df.join(most, "batch")
    width = F.size(F.get(chunk_col, F.lit(0)))
    missing = F.col("__most") - F.size(chunk_col)
    blank = F.transform(F.get(chunk_col, F.lit(0)), lambda x: x * 0)
    mask = F.concat(F.array_repeat(F.lit(True), F.size(chunk_col)), F.array_repeat(F.lit(False), missing))
    return out.withColumns({"chunk_mask": mask, chunk_col: F.when(width >= 0, F.concat(chunk_col, F.array_repeat(blank, missing))).otherwise(F.col(chunk_col))}).drop("__most")


def encode_tokens(ops: Column, vocabulary: tuple[str, ...]) -> Column:
    """Vocabulary place + 2; 0 is padding and 1 unknown."""
    ids = F.create_map(*[x for k, v in enumerate(vocabulary) for x in (F.lit(v), F.lit(k + 2))])
    return F.transform(ops, lambda x: F.coalesce(ids[x], F.lit(1)))


def chunked(ids: Column, width: int = 256, most: int = 16) -> Column:
    """Chunks of ``width``, the last padded with 0; beyond ``most``, evenly spaced ones (half to even)."""
    return bind(ids, lambda x: _chunked(x, width, most))


def _chunked(ids: Column, width: int, most: int) -> Column:
    n = F.greatest(F.lit(1), F.ceil(F.size(ids) / width).cast("int"))
    keep = F.transform(F.sequence(F.lit(0), F.least(n, F.lit(most)) - 1), lambda i: F.when(n <= most, i).otherwise(F.bround(i * (n - 1) / F.lit(most - 1)).cast("int")))
    part = lambda i: F.slice(ids, i * width + 1, width)
    return F.transform(keep, lambda i: F.concat(part(i), F.array_repeat(F.lit(0), F.lit(width) - F.size(part(i)))))


def downsample(ids: Column, length: int) -> Column:
    """At most ``length`` values at a uniform stride."""
    pick = lambda x: F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.get(x, F.floor(i * F.size(x) / F.lit(length)).cast("int")))
    return bind(ids, lambda x: F.when(F.size(x) <= length, x).otherwise(pick(x)))


def random_chunk(ids: Column, key: Column, width: int, stride: int) -> Column:
    """A sliding window chosen by the hash of a key."""
    places = F.greatest(F.lit(1), F.floor((F.size(ids) - width) / stride).cast("int") + 1)
    return F.slice(ids, (F.pmod(F.xxhash64(key), places) * stride + 1).cast("int"), width)


def dual_view(full: Column, restricted: Column, stats: Column | None = None) -> Column:
    """Full vector, restricted vector, their difference and, if given, statistics of what was left out, in one."""
    both = F.concat(full, restricted, F.zip_with(full, restricted, lambda a, b: a - b))
    return both if stats is None else F.concat(both, stats)


def image(h: Column, side: int = 224) -> Column:
    """Bytes as numbers in a flat array of side * side * 3, cut or filled with zeros."""
    n = side * side * 3
    v = F.transform(F.slice(F.regexp_extract_all(h, F.lit("(..)"), F.lit(1)), 1, n), lambda x: F.conv(x, 16, 10).cast("int"))
    return F.concat(v, F.array_repeat(F.lit(0), F.lit(n) - F.size(v)))


def frequency_ranks(tokens: DataFrame, col: str) -> DataFrame:
    """(token, n, code): rank by count, least frequent first, scaled to 0..255."""
    counts = tokens.groupBy(col).agg(F.count("*").alias("n"))
    out = ranked(counts, [("n", False), (col, False)], "r").withColumn("r", F.col("r") - 1)
    top = materialize(out, "ranks")
    last = top.agg(F.greatest(F.max("r"), F.lit(1)).alias("top"))
    return top.crossJoin(F.broadcast(last)).select(col, "n", F.bround(F.col("r") * 255 / F.col("top")).cast("int").alias("code"))  # one row


def lookup_image(instr: DataFrame, id_col: str, pos_col: str, columns: list[str], side: int = 224) -> DataFrame:
    """(id, row, col, <column>_code...): frequency codes of several columns placed row by row."""
    out = instr.where(F.col(pos_col) < side * side)
    for c in columns:
        out = out.join(frequency_ranks(instr, c).select(c, F.col("code").alias(f"{c}_code")), c, "left")
    return out.select(id_col, F.floor(F.col(pos_col) / side).cast("int").alias("row"), (F.col(pos_col) % side).alias("col"), *[F.coalesce(f"{c}_code", F.lit(0)).alias(f"{c}_code") for c in columns])


def factorize(tokens: DataFrame, order: list[str], col: str) -> DataFrame:
    """Codes by first appearance in the given order: (token, code)."""
    first = tokens.groupBy(col).agg(F.min(F.struct(*order)).alias("first"))
    return ranked(first, [("first", False)], "__k").select(col, (F.col("__k") - 1).cast("int").alias("code"))


def interleaved(instr: DataFrame, id_col: str, pos_col: str, op_col: str, operand_col: str, length: int) -> DataFrame:
    """(id, tokens): each opcode followed by its operand if it has one, cut or padded to ``length``."""
    rows = F.array_sort(F.collect_list(F.struct(pos_col, op_col, operand_col)))
    flat = F.flatten(F.transform(rows, lambda r: F.array_compact(F.array(r[op_col], r[operand_col]))))
    cut = F.slice(F.col("t"), 1, length)
    return instr.groupBy(id_col).agg(flat.alias("t")).select(id_col, F.concat(cut, F.array_repeat(F.lit("<PAD>"), F.lit(length) - F.size(cut))).alias("tokens"))


#: Tokens whose grams a task holds at once (a longer row alone), and buckets in which occurrences are counted first.
TOKENS_AT_ONCE, BUCKETS = 1 << 18, 1 << 22
_PIECES = 64
_FACTOR = np.uint64(0xC4CEB9FE1A85EC53)


def _word_hash(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def _gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams of a sequence of words' hashes."""
    with np.errstate(over="ignore"):
        out = np.zeros(max(len(words) - k + 1, 0), np.uint64)
        for j in range(k):
            out = out * _FACTOR + words[j : len(words) - k + 1 + j]
        return _mixed(out)


def token_chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[str], np.ndarray]]:
    """First row, tokens of each row, their codes, different tokens and these tokens' hashes, for some rows at a time."""
    size = batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, i = np.cumsum(size), 0
    while i < len(size):
        j = max(int(np.searchsorted(total, (total[i - 1] if i else 0) + TOKENS_AT_ONCE, "right")), i + 1)
        coded = batch.column(1).slice(i, j - i).flatten().dictionary_encode()
        tokens = coded.dictionary.to_pylist()
        yield i, size[i:j], coded.indices.to_numpy(), tokens, np.fromiter(map(_word_hash, tokens), np.uint64, len(tokens))
        i = j


def _grams(size: np.ndarray, words: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """k, start and hash of each gram that lies within a row, for k from 1 to ``most``."""
    left = np.repeat(np.cumsum(size), size) - np.arange(len(words))
    for k in range(1, most + 1):
        at = np.flatnonzero(left >= k)
        yield k, at, _gram_hashes(words, k)[at]


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(BUCKETS)).astype(np.int64)


def _occurrences(rows: DataFrame, most: int) -> np.ndarray:
    """How many grams fall into each bucket, which bounds how often each of them occurs; one vector of fixed size."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, size, codes, _, hashes in token_chunks(batch):
                for _, _, h in _grams(size, hashes[codes], most):
                    np.add.at(n, _bucket(h), 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(_PIECES), pa.int32()), pa.array([x.tobytes() for x in np.split(n, _PIECES)], pa.binary())], ["piece", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, n in zip(batch.column(0).to_pylist(), batch.column(1)):
                total[piece] = total.get(piece, 0) + np.frombuffer(n.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["piece", "n"])

    ddl = "piece int, n binary"
    out = np.zeros((_PIECES, BUCKETS // _PIECES), np.int64)
    for r in rows.mapInArrow(of, ddl).repartition("piece").mapInArrow(add, ddl).collect():  # a row per piece
        out[r.piece] = np.frombuffer(r.n, np.int64)
    return out.ravel()


def _counted_grams(rows: DataFrame, most: int, wanted: np.ndarray) -> DataFrame:
    """(gram, df, n): rows with and occurrences of each gram whose bucket is wanted."""
    bits = np.packbits(wanted)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.unpackbits(bits).astype(bool)
        for batch in batches:
            for _, size, codes, tokens, hashes in token_chunks(batch):
                row = np.repeat(np.arange(len(size)), size)
                grams, df, n = [], [], []
                for k, at, h in _grams(size, hashes[codes], most):
                    some = keep[_bucket(h)]
                    at, h = at[some], h[some]
                    own, first, which = np.unique(h, return_index=True, return_inverse=True)
                    pair = np.unique(which * len(size) + row[at]) // max(len(size), 1)
                    grams += [" ".join(tokens[c] for c in codes[i : i + k]) for i in at[first].tolist()]
                    df.append(np.bincount(pair, minlength=len(own)))
                    n.append(np.bincount(which, minlength=len(own)))
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(np.concatenate(df)), pa.array(np.concatenate(n))], ["gram", "df", "n"])

    return rows.mapInArrow(of, "gram string, df long, n long").groupBy("gram").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))


def tfidf_terms(train: DataFrame, id_col: str, tokens: Column, most: int = 4, vocab: int = 20_000, min_df: int = 3) -> DataFrame:
    """(gram, idf) learnt from training rows: ln((1 + rows) / (1 + rows with the gram)) + 1.

    Kept are the ``vocab`` most frequent of the grams that ``min_df`` rows have,
    ties by the gram. Ids must differ, and tokens have no blanks.

    Grams are counted in buckets first. Only those whose bucket holds enough are then counted by
    themselves: when ``vocab`` of them reach the bound, every gram left out is rarer than these. Else
    the bound is lowered, at last to ``min_df``, which leaves out none that may be kept.
    """
    bounded_batches(train.sparkSession)
    rows = train.count()
    own = train.select(id_col, tokens.alias("__tokens"))
    held = _occurrences(own, most)
    least = max(min_df, int(np.partition(held, -vocab)[-vocab]) // 2) if vocab < BUCKETS else min_df
    while True:
        grams = materialize(_counted_grams(own, most, held >= least).where(F.col("df") >= min_df), "grams")
        if least <= min_df or grams.where(F.col("n") >= least).count() >= vocab:
            break
        least = max(min_df, least // 4)
    top = grams.orderBy(F.desc("n"), "gram").limit(vocab)
    return materialize(top.select("gram", (F.log((F.lit(1.0) + rows) / (F.lit(1.0) + F.col("df"))) + 1).alias("idf")), "terms")


def tfidf_vectors(df: DataFrame, terms: DataFrame, id_col: str, tokens: Column, most: int = 4) -> DataFrame:
    """(id, terms): the known grams of each row as (gram, weight), by gram, of length one; rows without one don't appear.

    Ids must differ. Terms are matched by a hash of 64 bits.
    """
    bounded_batches(df.sparkSession)
    known = terms.orderBy("gram").toArrow()  # the vocabulary's size bounds the terms
    names, idf = known.column("gram").combine_chunks().cast(pa.string()), known.column("idf").to_numpy()
    hashes = np.array([_gram_hashes(np.array([_word_hash(w) for w in g.split(" ")], np.uint64), g.count(" ") + 1)[0] for g in names.to_pylist()], np.uint64)
    order = np.argsort(hashes)
    sorted_ = hashes[order]
    schema = T.StructType([df.schema[id_col], T.StructField("terms", T.ArrayType(T.StructType([T.StructField("gram", T.StringType()), T.StructField("weight", T.DoubleType())])))])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(order):
                continue
            for start, size, codes, _, words in token_chunks(batch):
                row, found = np.repeat(np.arange(len(size)), size), []
                for _, at, h in _grams(size, words[codes], most):
                    place = np.minimum(np.searchsorted(sorted_, h), len(order) - 1)
                    hit = sorted_[place] == h
                    found.append(row[at[hit]] * len(order) + order[place[hit]])
                pair, n = np.unique(np.concatenate(found), return_counts=True)
                own, term = pair // len(order), pair % len(order)
                w = n * idf[term]
                w = w / np.sqrt(np.bincount(own, w * w, len(size)))[own]
                many = np.bincount(own, minlength=len(size))
                some = np.flatnonzero(many)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many[some])]), pa.int32()), pa.StructArray.from_arrays([names.take(pa.array(term)), pa.array(w)], ["gram", "weight"]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(start + some)), lists], [id_col, "terms"])

    return df.select(id_col, tokens.alias("__tokens")).mapInArrow(of, schema)
