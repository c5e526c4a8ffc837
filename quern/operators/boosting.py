"""Second-order boosted trees: histograms summed over tasks, one pass over the rows per level.

Columns are cut into bins once. At each level every task sums the gradients and
hessians of its rows per node, column and bin; the sums meet per column, the
best split of each column is found there, and the driver sees one candidate per
node and task. Several models can be fitted in the same passes, each on its own
rows, such as one per held-out fold.

Gradients and hessians are whole numbers of 2 ** -26, so that sums, and with
them the trees, don't depend on how rows are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.draws import uniform
from quern.plans.materialize import materialize

SCALE = 1 << 26
#: Edges of a column at most, and the code of a missing value.
MOST_EDGES, MISSING = 254, 255
#: Trees between two writings of the rows' margins; those since are evaluated again in each pass.
KEPT_TREES = 16


@dataclass
class Tree:
    """A binary tree by place: the children of node i are 2 i + 1 and 2 i + 2; a column of -1 is a leaf."""

    column: np.ndarray
    edge: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, int), np.zeros(n, bool), np.zeros(n))

    def leaf(self, codes: np.ndarray) -> np.ndarray:
        """The node at which each row of codes ends."""
        at, rows = np.zeros(len(codes), int), np.arange(len(codes))
        while True:
            column = self.column[at]
            inner = column >= 0
            if not inner.any():
                return at
            x = codes[rows, np.maximum(column, 0)]
            left = np.where(x == MISSING, self.missing_left[at], x <= self.edge[at])
            at = np.where(inner, 2 * at + 2 - left, at)


@dataclass
class Boosted:
    """Fitted models over the same columns and edges; ``trees`` and ``base`` have one entry per model."""

    columns: list[str]
    edges: list[np.ndarray]
    base: list[float]
    trees: list[list[Tree]] = field(default_factory=list)

    def codes(self, values: np.ndarray) -> np.ndarray:
        """Bins of each value: how many edges are below it, MISSING for NaN."""
        out = np.empty(values.shape, np.uint8)
        for k, edges in enumerate(self.edges):
            out[:, k] = np.where(np.isnan(values[:, k]), MISSING, np.searchsorted(edges, values[:, k]))
        return out

    def margins(self, codes: np.ndarray, since: int = 0) -> np.ndarray:
        """Sums of the trees from ``since`` on, a column per model."""
        out = np.zeros((len(codes), len(self.base)))
        for m, trees in enumerate(self.trees):
            for tree in trees[since:]:
                out[:, m] += tree.value[tree.leaf(codes)]
        return out

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with ``scores``: the positive probability by each model."""
        columns, names = self.columns, df.columns
        rows = df.select("*", *[F.col(c).cast("double").alias(f"__x{k}") for k, c in enumerate(columns)])

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = self.margins(self.codes(_values(batch, len(names), len(columns)))) + np.array(self.base)
                p = _probability(own)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], lists], [*names, "scores"])

        return rows.mapInArrow(of, T.StructType([*df.schema, T.StructField("scores", T.ArrayType(T.DoubleType()))]))


def _values(batch: pa.RecordBatch, at: int, n: int) -> np.ndarray:
    return np.stack([batch.column(at + k).to_numpy(zero_copy_only=False).astype(float) for k in range(n)], 1) if n else np.zeros((batch.num_rows, 0))


def _probability(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def column_edges(df: DataFrame, columns: list[str], bins: int = MOST_EDGES) -> list[np.ndarray]:
    """Edges of each column, ascending: midpoints if it has few different values, else of its quantiles."""
    share = [k / (bins + 1) for k in range(bins + 2)]
    long = df.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("k", "x")).where("x is not null and not isnan(x)")
    found = {r.k: r.q for r in long.groupBy("k").agg(F.percentile_approx("x", share, 100_000).alias("q")).collect()}  # one row per column
    out = []
    for k in range(len(columns)):
        values = np.unique([x for x in found.get(k, []) if np.isfinite(x)])
        out.append((values[1:] + values[:-1]) / 2)
    return out


def _rows(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, labels, the models' bits, codes and margins of a batch of prepared rows."""
    key, y, uses = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
    codes = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(len(key), n)
    margins = np.frombuffer(b"".join(batch.column(4).to_pylist()), float).reshape(len(key), -1)
    return key, y, uses, codes, margins


def gradients(y: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the logistic loss, as whole numbers of 1 / SCALE."""
    p = _probability(margin)
    return np.rint((p - y) * SCALE).astype(np.int64), np.rint(p * (1 - p) * SCALE).astype(np.int64)


def _histograms(model: Boosted, growing: list[Tree], open_: list[list[int]], since: int, turn: int, rows: float, seed: int, chosen: list[list[int]]):
    """(model, col, at, sums): the sums of a task's rows by bin, for the open nodes of each model's growing tree.

    ``at`` is the place of a node's bin among all of that column's, those without rows being left out.
    """
    widths = [np.array([len(model.edges[c]) + 2 for c in own]) for own in chosen]  # bins, and the missing values
    # a column's bins lie together, those of a node one after the other
    first = [np.concatenate([[0], np.cumsum(w)]) * len(nodes) for w, nodes in zip(widths, open_)]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [(np.zeros(0, np.int64), np.zeros((2, 0), np.int64)) for _ in open_]
        for batch in batches:
            if not batch.num_rows:
                continue
            key, y, uses, codes, margins = _rows(batch, len(model.columns))
            margins = margins + model.margins(codes, since)
            drawn = uniform(key, seed, turn) < rows
            for m, nodes in enumerate(open_):
                own = np.flatnonzero(drawn & ((uses >> m) & 1 == 1)) if nodes and chosen[m] else []
                if not len(own):
                    continue
                place = np.full(len(growing[m].column), -1)
                place[nodes] = np.arange(len(nodes))
                node = place[growing[m].leaf(codes[own])]
                own, node = own[node >= 0], node[node >= 0]
                code = codes[np.ix_(own, chosen[m])]
                code = np.where(code == MISSING, widths[m] - 1, code)
                at = (first[m][:-1] + node[:, None] * widths[m] + code).ravel()
                w = np.stack([np.repeat(x, len(widths[m])) for x in gradients(y[own], margins[own, m])])
                total[m] = _added(np.concatenate([total[m][0], at]), np.concatenate([total[m][1], w], 1), int(first[m][-1]))
        out = []
        for m, (at, sums) in enumerate(total):
            cut = np.searchsorted(at, first[m])
            for k, c in enumerate(chosen[m]):
                i, j = cut[k], cut[k + 1]
                if i < j:
                    out.append((m, c, (at[i:j] - first[m][k]).astype(np.int32).tobytes(), np.ascontiguousarray(sums[:, i:j]).tobytes()))
        for i in range(0, len(out), 256):
            yield _batch(out[i : i + 256], _SUMS)

    return of


def _added(at: np.ndarray, values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places below ``size``, ascending, and the sums of their values; sums must be exact in doubles."""
    if len(at) * 8 < size:
        own, which = np.unique(at, return_inverse=True)
        return own, np.stack([np.bincount(which, v, len(own)).astype(np.int64) for v in values])
    sums = np.stack([np.bincount(at, v, size).astype(np.int64) for v in values])
    own = np.flatnonzero(sums.any(0))
    return own, sums[:, own]


_SUMS = pa.schema([("model", pa.int32()), ("col", pa.int32()), ("at", pa.binary()), ("sums", pa.binary())])
_SPLIT = pa.schema([("model", pa.int32()), ("node", pa.int32()), ("col", pa.int32()), ("edge", pa.int32()), ("missing_left", pa.bool_()), ("gain", pa.float64()), *[(k, pa.int64()) for k in ("gl", "hl", "g", "h")]])
_SUMS_DDL = "model int, col int, at binary, sums binary"
_SPLIT_DDL = "model int, node int, col int, edge int, missing_left boolean, gain double, gl long, hl long, g long, h long"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), schema)], schema=schema)


def best_splits(sums: np.ndarray, l2: float, least: float) -> list[tuple[int, bool, float, int, int, int, int]]:
    """The best edge of each node from a column's sums (gradient or hessian, node, bin), missing values in the last bin.

    (edge, missing goes left, gain, left gradient and hessian, all gradient and hessian); a gain of -inf is none.
    """
    score = lambda a, b: (a / SCALE) ** 2 / (b / SCALE + l2)
    g, h = sums.sum(2)
    best, out = np.full(len(g), -np.inf), np.zeros((5, len(g)), np.int64)
    for left in (False, True):
        gl, hl = np.cumsum(sums[:, :, :-2], 2) + left * sums[:, :, -1:]
        gr, hr = g[:, None] - gl, h[:, None] - hl
        gain = np.where((hl >= least * SCALE) & (hr >= least * SCALE), score(gl, hl) + score(gr, hr) - score(g, h)[:, None], -np.inf)
        k = gain.argmax(1)
        rows = np.arange(len(g))
        better = gain[rows, k] > best
        best = np.where(better, gain[rows, k], best)
        out = np.where(better, [k, np.full(len(g), left), gl[rows, k], hl[rows, k], rows], out)
    return [(int(e), bool(m), float(x), int(a), int(b), int(c), int(d)) for e, m, x, a, b, c, d in zip(out[0], out[1], best, out[2], out[3], g, h)]


def _splits(open_: list[list[int]], edges: list[int], l2: float, least: float):
    """The best split of each node among the columns of this task."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for m, c, at, sums in zip(*(x.to_pylist() for x in batch.columns)):
                if (m, c) not in total:
                    total[m, c] = np.zeros((2, len(open_[m]) * (edges[c] + 2)), np.int64)
                total[m, c][:, np.frombuffer(at, np.int32)] += np.frombuffer(sums, np.int64).reshape(2, -1)
        best: dict[tuple[int, int], tuple] = {}
        for (m, c), sums in sorted(total.items()):
            own = best_splits(sums.reshape(2, len(open_[m]), -1), l2, least)
            for node, (edge, left, gain, gl, hl, g, h) in zip(open_[m], own):
                if h and ((m, node) not in best or gain > best[m, node][5]):
                    best[m, node] = (m, node, c, edge, left, gain, gl, hl, g, h)
        if best:
            yield _batch(list(best.values()), _SPLIT)

    return of


def fit(
    df: DataFrame, columns: list[str], key: str | Column, y: str = "y", *, uses: Column | None = None, models: int = 1, rounds: int = 300, depth: int = 6, rate: float = 0.1,
    rows: float = 0.9, share: float = 0.8, l2: float = 1.0, least: float = 1.0, bins: int = MOST_EDGES, seed: int = 7702,
) -> Boosted:
    """Boosted trees for a label of 0 or 1.

    Each tree draws ``rows`` of the rows, by a hash of ``key``, and ``share`` of
    the columns that have different values. A split needs a hessian of ``least`` on both sides and a gain
    above zero; leaves are shrunk by ``l2`` and ``rate``. Nulls and NaN go to the
    side that gains more. Bit m of ``uses`` says that a row teaches model m (all
    rows teach all by default). Rows with a null label teach nothing. Edges come
    from all rows with a label. No rows: every margin is zero.
    """
    df = df.where(F.col(y).isNotNull())
    every = (1 << models) - 1
    mask = F.coalesce(uses.cast("long"), F.lit(0)) if uses is not None else F.lit(every).cast("long")
    model = Boosted(columns, column_edges(df, columns, bins), [0.0] * models, [[] for _ in range(models)])
    src = df.select(F.xxhash64(key).alias("key"), F.col(y).cast("double").alias("y"), mask.alias("uses"), *[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(columns)])
    counts = src.agg(*[F.sum(F.when(F.getbit("uses", F.lit(m)) == 1, v)).alias(f"{n}{m}") for m in range(models) for n, v in (("n", F.lit(1)), ("p", F.col("y")))]).first()
    for m in range(models):
        n, p = counts[f"n{m}"] or 0, counts[f"p{m}"] or 0.0
        if 0 < p < n:
            model.base[m] = float(np.log(p / (n - p)))
    zero = np.array(model.base).tobytes()

    def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = model.codes(_values(batch, 3, len(columns)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([zero] * len(codes), pa.binary())], ["key", "y", "uses", "codes", "margins"])

    ddl = "key long, y double, uses long, codes binary, margins binary"
    held = materialize(src.mapInArrow(prepared, ddl), "boosting").persist()
    rng, since, lots = np.random.default_rng(seed), 0, min(32, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    some = [k for k, edges in enumerate(model.edges) if len(edges)]  # the others split nothing
    most = max(1, round(share * len(some)))
    for turn in range(rounds if some else 0):
        chosen = [sorted(rng.choice(some, most, replace=False).tolist()) for _ in range(models)]
        growing, open_ = [Tree.empty(depth) for _ in range(models)], [[0] for _ in range(models)]
        for _ in range(depth):
            sums = held.mapInArrow(_histograms(model, growing, open_, since, turn, rows, seed, chosen), _SUMS_DDL)
            found = sums.repartition(lots, "model", "col").mapInArrow(_splits(open_, [len(e) for e in model.edges], l2, least), _SPLIT_DDL).collect()  # one row per node and task
            open_ = _grow(growing, found, rate, l2)
            if not any(open_):
                break
        for trees, tree in zip(model.trees, growing):
            trees.append(tree)
        if turn + 1 - since == KEPT_TREES and turn + 1 < rounds:
            before, held = held, materialize(held.mapInArrow(_with_margins(model, since), ddl), "boosting").persist()
            held.count()
            before.unpersist()
            since = turn + 1
    held.unpersist()
    return model


def _with_margins(model: Boosted, since: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, _, codes, margins = _rows(batch, len(model.columns))
            new = margins + model.margins(codes, since)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([x.tobytes() for x in new], pa.binary())], batch.schema.names)

    return of


def _grow(growing: list[Tree], found: list, rate: float, l2: float) -> list[list[int]]:
    """Splits the open nodes by the best of the candidates, and returns the nodes that are open then."""
    best: dict[tuple[int, int], object] = {}
    for r in sorted(found, key=lambda r: (-r.gain, r.col)):
        best.setdefault((r.model, r.node), r)
    out: list[list[int]] = [[] for _ in growing]
    weight = lambda g, h: -rate * (g / SCALE) / (h / SCALE + l2)
    for (m, node), r in sorted(best.items()):
        tree = growing[m]
        tree.value[node] = weight(r.g, r.h)
        if r.gain > 0:
            tree.column[node], tree.edge[node], tree.missing_left[node] = r.col, r.edge, r.missing_left
            tree.value[2 * node + 1], tree.value[2 * node + 2] = weight(r.gl, r.hl), weight(r.g - r.gl, r.h - r.hl)
            if 4 * node + 4 < len(tree.column):
                out[m] += [2 * node + 1, 2 * node + 2]
    return out


def leave_fold_out(df: DataFrame, columns: list[str], key: str | Column, k: int = 5, y: str = "y", **params) -> DataFrame:
    """``df`` (with ``fold``) twice: (turn, role, score) as test rows and as validation rows, by models that saw neither.

    The model of turn t learns from all folds but t (test) and t + 1
    (validation); all k models grow in the same passes.
    """
    role = lambda t: (F.col("fold") == t, F.col("fold") == (t + 1) % k)
    bits = [F.when(role(t)[0] | role(t)[1] | F.col("fold").isNull(), 0).otherwise(1 << t) for t in range(k)]
    model = fit(df, columns, key, y, uses=sum(bits[1:], bits[0]), models=k, **params)
    scored = materialize(model.score(df), "scores")
    each = [F.struct(F.lit(t).alias("turn"), F.lit(name).alias("role"), c.alias("own")) for t in range(k) for name, c in zip(("test", "validation"), role(t))]
    rows = scored.withColumn("__t", F.explode(F.filter(F.array(*each), lambda s: s["own"])))
    return rows.select(*df.columns, F.col("__t.turn").alias("turn"), F.col("__t.role").alias("role"), F.get("scores", F.col("__t.turn")).alias("score"))
