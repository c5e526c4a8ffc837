"""Approximate nearest neighbours by collision counting over sorted projections.

Rows are indexed in blocks. A block keeps, for each of several random
projections, its values in sorted order and each row's rank. A query opens a
window around its own value in every projection; widening all windows together
is the virtual rehashing. A row whose rank lies in enough windows is verified
by its true distance. The windows widen until a row as near as the k-th found
would be seen. The k-th distance found goes along from block to block and
gives the width of the windows there at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import bounded_batches
from quern.plans.materialize import materialize

#: Rows of a block, at most 65536; bytes of queries sent to every task in one pass.
BLOCK, QUERY_BYTES = 8192, 8 << 20
#: Projections, at most 255; share of the windows that a row must lie in; standard errors by which
#: a row at the k-th distance is above that share.
PROJECTIONS, SHARE, MARGIN = 128, 0.86, 1.0


def _projection(dim: int, m: int) -> np.ndarray:
    return np.random.default_rng(dim * 1009 + 7).standard_normal((dim, m))


def _stop_ratio(m: int, share: float, margin: float) -> float:
    """Half-width over distance at which a row is in share * m windows, with a margin."""
    want = min(0.999, share + margin * sqrt(share * (1 - share) / m))
    lo, hi = 0.0, 10.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if erf(mid / sqrt(2)) < want else (lo, mid)
    return hi


def _index(block: int, m: int):
    """Index rows: ids, vectors and sorted projections of at most ``block`` rows."""

    def pack(ids: list[int], vecs: np.ndarray) -> pa.RecordBatch:
        p = (vecs @ _projection(vecs.shape[1], m)).T
        order = np.argsort(p, axis=1, kind="stable")
        rank = np.empty(p.shape, np.uint16)
        np.put_along_axis(rank, order, np.broadcast_to(np.arange(len(ids), dtype=np.uint16), p.shape), 1)
        values = np.take_along_axis(p, order, 1).astype(np.float32)
        short = vecs.astype(np.float32)
        kept = short if (short == vecs).all() else vecs  # single precision only where that is exact
        binary = [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (np.array(ids, np.int64), kept, values, rank)]
        return pa.RecordBatch.from_arrays([pa.array([vecs.shape[1]], pa.int32()), *binary], ["dim", "ids", "vecs", "vals", "ranks"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[int], list[np.ndarray]]] = {}
        for batch in batches:
            column = batch.column(1)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            cut = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
            for k, i in enumerate(batch.column(0).to_pylist()):
                v = flat[cut[k] : cut[k + 1]]
                ids, vecs = held.setdefault(len(v), ([], []))
                ids.append(i)
                vecs.append(v)
                if len(ids) >= block:
                    yield pack(ids, np.stack(vecs))
                    held[len(v)] = ([], [])
        for ids, vecs in held.values():
            if ids:
                yield pack(ids, np.stack(vecs))

    return of


def _first_of_ids(ids: np.ndarray, dist: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest ids, each once, by distance and then id."""
    order, n = np.lexsort((ids, dist)), 2 * k
    while True:
        _, first = np.unique(ids[order[:n]], return_index=True)
        if len(first) >= k or n >= len(order):
            return order[np.sort(first)[:k]]
        n *= 4


class Block:
    """Rows with their sorted projections and ranks."""

    def __init__(self, dim: int, m: int, ids: bytes, vecs: bytes, values: bytes, ranks: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.vecs = np.frombuffer(vecs, np.float32 if len(vecs) == 4 * dim * len(self.ids) else np.float64).reshape(-1, dim)
        self.values = np.frombuffer(values, np.float32).reshape(m, -1)
        self.ranks = np.frombuffer(ranks, np.uint16).reshape(m, -1)
        self.different = np.unique(self.ids)
        # below this, a difference of projections may be rounding
        self.least = 1e-5 * float(np.abs(self.values[:, [0, -1]]).max()) + 1e-12

    def others(self, own: int) -> int:
        at = np.searchsorted(self.different, own)
        return len(self.different) - int(at < len(self.different) and self.different[at] == own)

    def windows(self, qp: np.ndarray, half: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
        """First rank and length of each query's window in each projection (queries by projections)."""
        low, high = (qp - half).T.astype(np.float32), (qp + half).T.astype(np.float32)
        lo = np.array([v.searchsorted(x) for v, x in zip(self.values, low)]).T
        hi = np.array([v.searchsorted(x, "right") for v, x in zip(self.values, high)]).T
        return lo, hi - lo

    def inside(self, lo: np.ndarray, width: np.ndarray) -> np.ndarray:
        """In how many windows of one query each row lies."""
        # ranks before a window wrap round and are not less than its length
        hit = self.ranks - lo.astype(np.uint16)[:, None] < np.minimum(width, 65535).astype(np.uint16)[:, None]
        hit[width > 65535] = True
        return np.add.reduce(hit.view(np.uint8), 0, np.uint8)

    def distances(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        d = self.vecs[rows].astype(np.float64) - q
        return np.sqrt((d * d).sum(1))

    def first_rows(self, own: int, counts: np.ndarray, k: int) -> np.ndarray:
        """Rows of other ids in the most windows, so many that k different ids are among them."""
        order = np.argsort(-counts.astype(np.int16), kind="stable")
        order = order[self.ids[order] != own]
        many = 4 * k
        while len(np.unique(self.ids[order[:many]])) < k:
            many *= 4
        return order[:many]

    def search(self, q: np.ndarray, own: np.ndarray, qp: np.ndarray, k: int, need: int, ratio: float, bound: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, rows of other ids verified, their distances) of each query.

        Where ``bound`` tells no distance of a k-th neighbour (it is infinite), windows first open
        over half of the rows, and those in the most windows are verified. The windows then take
        the width that the k-th distance asks for.
        """
        bound, first = bound.copy(), {}
        some = np.array([self.others(x) for x in own], np.int64)
        open_ = np.flatnonzero(np.isinf(bound) & (some > 0))
        n = self.values.shape[1]
        lo, width = self.windows(qp[open_], max(0.5 * float((self.values[:, 3 * n // 4] - self.values[:, n // 4]).mean()), self.least))
        for j, at in enumerate(open_.tolist()):
            kth = min(k, int(some[at]))
            first[at] = self.first_rows(own[at], self.inside(lo[j], width[j]), kth)
            dist = self.distances(first[at], q[at])
            bound[at] = dist[_first_of_ids(self.ids[first[at]], dist, kth)[-1]]
        todo = np.flatnonzero(some > 0)
        lo, width = self.windows(qp[todo], np.maximum(ratio * bound[todo], self.least)[:, None])
        for j, at in enumerate(todo.tolist()):
            hit = (self.inside(lo[j], width[j]) >= need) & (self.ids != own[at])
            if at in first:
                hit[first[at]] = True
            rows = np.flatnonzero(hit)
            yield at, rows, self.distances(rows, q[at])


def _search(q_ids: np.ndarray, q: np.ndarray, k: int, m: int, share: float, margin: float):
    qp = q @ _projection(q.shape[1], m) if len(q) else q
    need, ratio = max(1, int(np.ceil(share * m))), _stop_ratio(m, share, margin)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, int]]] = [[] for _ in q_ids]
        for batch in batches:
            for r in range(batch.num_rows):
                block = Block(q.shape[1], m, *(batch.column(c)[r].as_py() for c in ("ids", "vecs", "vals", "ranks")))
                bound = np.array([x[-1][0] if len(x) == k else np.inf for x in best])
                for at, rows, dist in block.search(q, q_ids, qp, k, need, ratio, bound):
                    rows, dist = rows[dist <= bound[at]], dist[dist <= bound[at]]
                    if not len(rows):
                        continue
                    pick = _first_of_ids(block.ids[rows], dist, k)
                    merged, seen = [], set()
                    for x in sorted([*best[at], *zip(dist[pick].tolist(), block.ids[rows][pick].tolist())]):
                        if x[1] not in seen:
                            seen.add(x[1])
                            merged.append(x)
                    best[at] = merged[:k]
        found = [(int(q_ids[at]), i, d) for at, own in enumerate(best) for d, i in own]
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    return of


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *, k: int = 10, projections: int = PROJECTIONS, share: float = SHARE, margin: float = MARGIN, block: int = BLOCK) -> DataFrame:
    """The ``k`` nearest found of each query: (query_id, rank, vec_id, score).

    score is the Euclidean distance in double precision; ties go to the smaller
    id. A query never finds rows of its own id. All rows are indexed.

    Vectors that are null, empty, zero, or hold null or non-finite components
    take no part, nor do rows without an id; vectors of another length than the
    query's are no candidates. Of several vectors of one id the nearest counts
    as a candidate and the smallest as a query. Equal vectors always meet. With
    fewer than ``k`` candidates all are returned. Empty tables give an empty
    result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)

    def clean(df: DataFrame) -> DataFrame:
        v = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
        finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return v.where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))

    index = materialize(clean(vectors).distinct().mapInArrow(_index(block, projections), "dim int, ids binary, vecs binary, vals binary, ranks binary"), "index")
    asked = materialize(clean(queries).groupBy("id").agg(F.min("v").alias("v")), "queries")
    stats = asked.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy("dim").collect()
    schema, found = "query_id long, vec_id long, score double", None
    for dim, n in stats:
        lots = max(1, -(-n * (dim + projections) * 8 // QUERY_BYTES))
        for lot in range(lots):  # a pass over the index for each bounded block of queries
            rows = asked.where((F.size("v") == dim) & (F.pmod(F.xxhash64("id"), F.lit(lots)) == lot)).collect()
            if not rows:
                continue
            fn = _search(np.array([r.id for r in rows], np.int64), np.array([r.v for r in rows]), k, projections, share, margin)
            part = index.where(F.col("dim") == dim).mapInArrow(fn, schema)
            part = materialize(part, "near") if lots > 1 else part
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_collision_counting(spark, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth, among all."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))
