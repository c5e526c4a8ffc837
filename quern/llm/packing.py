"""Packing documents into sequences: linear grouping, configurations, best fit.

All of the planning works on the histogram of piece lengths, which has at most
``capacity`` entries whatever the number of documents. Large lengths are
rounded up within groups of equal cardinality; a linear programme over
configurations of the few group sizes is solved by column generation; its
integer part places actual pieces, longest first, into the slots of their
group; what is left is placed by best fit. The plan is a bounded list of runs
"the r-th to s-th piece of length l go to sequences q, q+1, .. at offset o",
and each piece finds its run by its rank within its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import bounded_batches
from quern.llm.tokens import encoder
from quern.plans.materialize import materialize

#: Groups of large lengths; share of the capacity above which a length is large.
GROUPS, LARGE = 96, 0.4
#: Pieces of one length whose ranks are counted together.
RANK_BLOCK = 1_000_000


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids = enc.encode(batch.column(1).to_pylist())
            doc, piece, start, length, crc, raw = [], [], [], [], [], []
            for d, own in zip(batch.column(0).to_pylist(), ids):
                own += end
                n = len(own) // 4
                at, k = 0, 0
                size = (n - 1) % capacity + 1
                while at < n:
                    part = own[4 * at : 4 * (at + size)]
                    doc.append(d), piece.append(k), start.append(at), length.append(size), crc.append(zlib.crc32(part))
                    raw.append(part if with_ids else None)
                    at, k, size = at + size, k + 1, capacity
            columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(raw, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return of


def _knapsack(value: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best value of a multiset of sizes that fits, and how often each is taken."""
    some = np.flatnonzero(value > 1e-12)
    take = np.zeros(len(size), int)
    if not len(some):
        return 0.0, take
    low = int(size[some].min())
    # room before zero stays at minus infinity, so sizes that don't fit lose
    wide = int(size[some].max())
    best = np.full(capacity + 1 + wide, -np.inf)
    best[wide : wide + low] = 0
    last = np.full(capacity + 1, -1)
    back, worth = wide - size[some], value[some]
    for c in range(low, capacity + 1):
        got = best[back + c] + worth
        k = int(got.argmax())
        if got[k] > best[wide + c - 1] + 1e-12:
            best[wide + c], last[c] = got[k], some[k]
        else:
            best[wide + c] = best[wide + c - 1]
    c = capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            take[last[c]] += 1
            c -= size[last[c]]
    return float(best[-1]), take


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Configurations of the given sizes with whole counts, from the rounded-down
    optimum of the configuration programme; they never exceed the demand."""
    size, need = np.array(sizes), np.array(demand, float)
    m = len(size)
    basis = np.diag(np.maximum(capacity // size, 1)).astype(float)
    x = need / np.diag(basis)
    for _ in range(40 * m):
        price = np.linalg.solve(basis.T, np.ones(m))
        best, take = _knapsack(np.maximum(price, 0), size, capacity)
        if best <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, take.astype(float))
        up = step > 1e-9
        ratio = np.where(up, np.maximum(x, 0) / np.where(up, step, 1), np.inf)
        out = int(np.argmin(ratio))
        basis[:, out] = take
        x = np.linalg.solve(basis, need)
    left, found = np.array(demand), []
    for k in np.argsort(-x):
        config = basis[:, k].astype(int)
        used = config > 0
        n = min(int(np.floor(max(x[k], 0) + 1e-9)), int((left[used] // config[used]).min()))
        if n > 0:
            found.append((tuple(config), n))
            left = left - config * n
    return found


class _Bins:
    """Sequences with equal room, as runs of consecutive numbers."""

    def __init__(self, capacity: int):
        self.capacity, self.count = capacity, 0
        self.free: dict[int, list[tuple[int, int]]] = {}
        self.rooms: list[int] = []
        self.plan: list[tuple[int, int, int, int, int]] = []

    def put(self, room: int, first: int, n: int) -> None:
        if n and room:
            if room not in self.free:
                self.rooms.insert(bisect_left(self.rooms, room), room)
                self.free[room] = []
            self.free[room].append((first, n))

    def take(self, room: int, n: int) -> tuple[int, int]:
        first, have = self.free[room].pop()
        if have > n:
            self.free[room].append((first + n, have - n))
            have = n
        if not self.free[room]:
            del self.free[room]
            self.rooms.remove(room)
        return first, have

    def best_fit(self, length: int, rank: int, n: int) -> None:
        """Place n pieces of one length, first ranks first, each where least room is left."""
        while n:
            at = bisect_left(self.rooms, length)
            if at < len(self.rooms):
                room = self.rooms[at]
                first, have = self.take(room, n)
                self.plan.append((length, rank, have, first, self.capacity - room))
                self.put(room - length, first, have)
                rank, n = rank + have, n - have
            else:
                each = self.capacity // length
                full, rest = divmod(n, each)
                for k in range(each if full else 0):
                    self.plan.append((length, rank + k * full, full, self.count, k * length))
                self.put(self.capacity - each * length, self.count, full)
                self.count += full
                rank += each * full
                for k in range(rest):
                    self.plan.append((length, rank + k, 1, self.count, k * length))
                if rest:
                    self.put(self.capacity - rest * length, self.count, 1)
                    self.count += 1
                n = 0


def plan_packing(histogram: dict[int, int], capacity: int, groups: int = GROUPS, large: float = LARGE) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, pieces, first sequence, offset) and the number of sequences."""
    bins = _Bins(capacity)
    left = dict(histogram)
    if n := left.pop(capacity, 0):
        bins.plan.append((capacity, 0, n, 0, 0))
        bins.count = n
    rank = dict.fromkeys(left, 0)
    big = sorted((k for k in left if k > large * capacity), reverse=True)
    total = sum(left[k] for k in big)
    if total:
        per = -(-total // groups)
        group: list[list[list[int]]] = [[]]
        room = per
        for k in big:
            n = left[k]
            while n:
                if not room:
                    group.append([])
                    room = per
                some = min(n, room)
                group[-1].append([k, some])
                n, room = n - some, room - some
        sizes, demand = [g[0][0] for g in group], [sum(n for _, n in g) for g in group]
        merged: dict[int, list[int]] = {}
        for at, s in enumerate(sizes):
            merged.setdefault(s, []).append(at)
        top = sorted(merged, reverse=True)
        queue = {s: [x for at in merged[s] for x in group[at]] for s in top}
        found = configurations(top, [sum(demand[at] for at in merged[s]) for s in top], capacity)
        for config, n in found:
            first = bins.count
            bins.count += n
            runs = [(0, n, 0)]  # from the first sequence, how many, tokens used
            for s, times in zip(top, config):
                for _ in range(times):
                    filled = []
                    for begin, many, used in runs:
                        while many:
                            k, have = queue[s][0]
                            some = min(have, many)
                            bins.plan.append((k, rank[k], some, first + begin, used))
                            rank[k] += some
                            left[k] -= some
                            queue[s][0][1] -= some
                            if not queue[s][0][1]:
                                queue[s].pop(0)
                            filled.append((begin, some, used + k))
                            begin, many = begin + some, many - some
                    runs = filled
            for begin, many, used in runs:
                bins.put(capacity - used, first + begin, many)
    for k in sorted((k for k in left if left[k]), reverse=True):
        bins.best_fit(k, rank[k], left[k])
    return bins.plan, bins.count


def _placer(plan: list[tuple[int, int, int, int, int]]):
    by: dict[int, list[tuple[int, int, int, int]]] = {}
    for length, rank, n, first, offset in sorted(plan):
        by.setdefault(length, []).append((rank, n, first, offset))
    tables = {k: np.array(v, np.int64) for k, v in by.items()}

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            seq, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                run = tables[int(k)]
                which = np.searchsorted(run[:, 0], rank[at], "right") - 1
                seq[at] = run[which, 2] + rank[at] - run[which, 0]
                offset[at] = run[which, 3]
            keep = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(seq), pa.array(offset)], [*keep, "sequence_id", "offset"])

    return of


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Place every document's tokens in sequences of at most ``capacity`` ids.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset (and ids, little-endian unsigned 32-bit, if asked for). A document
    is its text's ids and ``end_id``; a longer one than ``capacity`` is cut
    into pieces of that many ids, the first taking the remainder.

    Null and empty texts are one end id. A null id is packed like any other.
    Repeated rows are packed each. Very long texts only make more pieces.
    Other columns are ignored, whatever their names. An empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = src.mapInArrow(_pieces(tokenizer_path, capacity, end_id, with_ids), schema)
    # ranks within a length are counted block by block: no length is one task's
    block = F.floor(F.rand(7) * F.lit(1 << 30)).cast("int")
    pieces = materialize(pieces.withColumn("__lot", block), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan, _ = plan_packing(counts, capacity)
    lots = max(1, -(-max(counts.values(), default=1) // RANK_BLOCK), 8)
    pieces = pieces.withColumn("__lot", F.col("__lot") % lots)
    before = Window.partitionBy("length").orderBy("__lot").rowsBetween(Window.unboundedPreceding, -1)
    lot = pieces.groupBy("length", "__lot").agg(F.count("*").alias("n"))
    lot = lot.select("length", "__lot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    own = Window.partitionBy("length", "__lot").orderBy("doc_id", "piece")
    ranked = pieces.withColumn("rank", F.row_number().over(own).cast("long") - 1).join(lot, ["length", "__lot"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("__base")).drop("__lot", "__base")
    names = [c for c in ["doc_id", "piece", "start", "length", "ids_crc32", "ids"] if c in ranked.columns]
    return ranked.select(*names, "rank").mapInArrow(_placer(plan), f"{schema}, sequence_id long, offset long")


def assemble(packed: DataFrame) -> DataFrame:
    """Sequences of ids from a packing that carries them: (sequence_id, n_tokens, ids)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    out = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("p"))
    return out.select("sequence_id", "n_tokens", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, tokenizer_path=public_tokenizers.path("byte_bpe_50k.json"))
