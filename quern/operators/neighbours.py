"""Exact nearest rows by pivots and distance ranges.

Each row belongs to its nearest pivot and, by its distance from it, to a cell
of bounded size. A query's first cell gives a bound on its k-th distance; by
the triangle inequality only cells whose range of distances comes within that
bound can hold nearer rows, and only those are searched. Cells meet blocks of
queries, so neither side is ever whole in one task or on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.ranges import ranked
from quern.plans.materialize import materialize

#: Pivots, rows of a cell at most, and bytes of query vectors that meet a cell at once.
PIVOTS, CELL, BLOCK_BYTES = 64, 2048, 1 << 20
#: Room for rounding, so that no row at the bound is left out.
_SLACK = 1e-9


def _usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): vectors as doubles, without null or empty ones and those with a null or non-finite part."""
    own = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return own.where(F.col("id").isNotNull() & (F.size("v") > 0) & ~bad)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a to all rows of b, each summed over its differences."""
    out = np.empty((len(a), len(b)))
    for k in range(len(a)):
        out[k] = np.sqrt(((b - a[k]) ** 2).sum(1))
    return out


def _assigned(pivots: np.ndarray):
    """(id, v, pivot, r): the nearest pivot and the distance to it."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = distances(_matrix(batch.column("v")), pivots)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.argmin(1), pa.int32()), pa.array(d.min(1))], [*batch.schema.names, "pivot", "r"])

    return of


def _reached(pivots: np.ndarray):
    """(id, pivot, d, off): a query's distance to each pivot, and how much farther that is than its nearest one."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(pivots)
        for batch in batches:
            if batch.num_rows:
                d = distances(_matrix(batch.column("v")), pivots)
                ids = np.repeat(batch.column("id").to_numpy(), n)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.tile(np.arange(n), len(d)), pa.int32()), pa.array(d.ravel()), pa.array((d - d.min(1, keepdims=True)).ravel())], ["id", "pivot", "d", "off"])

    return of


def _searched(k: int):
    """The k nearest rows of a cell for each query of a block."""
    names = ["id", "neighbour", "distance"]

    def of(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if len(rows) and len(asked):
            v, ids = _matrix(rows["v"]), rows["id"].to_numpy()
            for q, own in zip(_matrix(asked["v"]), asked["id"].to_pylist()):
                other = np.flatnonzero(ids != own)
                d = np.sqrt(((v[other] - q) ** 2).sum(1))
                top = np.lexsort((ids[other], d))[:k]
                out[0] += [own] * len(top)
                out[1] += ids[other][top].tolist()
                out[2] += d[top].tolist()
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names)

    return of


def search(left: DataFrame, right: DataFrame, id_col: str, vec_col: str, k: int = 1, *, pivots: int = PIVOTS, cell: int = CELL, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """The k nearest right rows of each left row, and what was compared.

    First table: (id, neighbour, distance, rank), Euclidean, nearest first, ties
    by the smaller id, without rows of the query's own id; exact. Second table:
    one row (queries, rows, compared), ``compared`` being pairs of a query and a
    row whose distance was computed. Rows with a null id, and vectors that are
    null, empty or not finite throughout, take no part; all others must have
    equal length. Query ids must differ; right ids may repeat, each row counting.
    No rows on either side: no result.
    """
    rows = materialize(_usable(right, id_col, vec_col), "rows")
    asked = materialize(_usable(left, id_col, vec_col), "asked")
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    total, spark = rows.count(), left.sparkSession
    stats = lambda pairs: spark.createDataFrame([(size.n, total, pairs)], "queries long, rows long, compared long")
    if not total or not size.n:
        return spark.createDataFrame([], "id long, neighbour long, distance double, rank int"), stats(0)
    blocks = max(1, -(-size.n * size.dim * 8 // block_bytes))
    order = Window.partitionBy("id").orderBy("distance", "neighbour")
    best = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def met(cells: DataFrame, pairs: DataFrame) -> DataFrame:
        own = pairs.join(asked, "id").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
        own = materialize(own.select("id", "pivot", "lot", "block", "v"), "pairs")
        many = own.select("pivot", "lot", F.col("block").alias("of")).distinct()
        near = cells.join(many, ["pivot", "lot"]).withColumnRenamed("of", "block").groupBy("pivot", "lot", "block").cogroup(own.groupBy("pivot", "lot", "block"))
        return materialize(near.applyInArrow(_searched(k), "id long, neighbour long, distance double"), "found")

    if total <= cell:  # one cell, which every query meets
        one = [F.lit(0).alias("pivot"), F.lit(0).alias("lot")]
        return best(met(rows.select("*", *one), asked.select("id", *one))), stats(total * size.n)
    chosen = rows.orderBy(F.xxhash64("id", "v"), "id").limit(pivots).collect()  # a bounded number of vectors
    p = np.unique(np.array([r.v for r in chosen], float), axis=0)
    dealt = rows.mapInArrow(_assigned(p), "id long, v array<double>, pivot int, r double")
    dealt = ranked(dealt, [("r", False), ("id", False)], "__place", by=("pivot",)).withColumn("lot", F.floor((F.col("__place") - 1) / cell).cast("int")).drop("__place")
    dealt = materialize(dealt, "cells")
    cells = materialize(dealt.groupBy("pivot", "lot").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high")), "bounds")
    reach = materialize(asked.select("id", "v").mapInArrow(_reached(p), "id long, pivot int, d double, off double"), "reach")

    # the cell of the query's own pivot whose distances are nearest its own
    home = reach.join(cells, "pivot").withColumn("gap", F.greatest(F.col("low") - F.col("d"), F.col("d") - F.col("high"), F.lit(0.0)))
    home = materialize(home.groupBy("id").agg(F.min_by(F.struct("pivot", "lot"), F.struct("off", "gap", "lot")).alias("c")).select("id", "c.*"), "home")
    first = met(dealt, home)
    bound = first.groupBy("id").agg(F.count("*").alias("n"), F.max("distance").alias("b")).where(F.col("n") >= k).select("id", (F.col("b") * (1 + _SLACK) + _SLACK).alias("bound"))
    within = F.coalesce(F.col("bound"), F.lit(float("inf")))
    near = (F.col("low") <= F.col("d") + within) & (F.col("high") >= F.col("d") - within) & (F.col("off") <= 2 * within + _SLACK)
    rest = reach.join(bound, "id", "left").join(cells, "pivot").where(near).select("id", "pivot", "lot").join(home, ["id", "pivot", "lot"], "left_anti")
    rest = materialize(rest, "rest")
    compared = home.unionByName(rest).join(cells, ["pivot", "lot"]).agg(F.sum("n").alias("n")).first().n
    return best(first.unionByName(met(dealt, rest))), stats(compared)


def scaled(df: DataFrame, train: DataFrame, vec_col: str) -> DataFrame:
    """``df`` with each place of the vector scaled by the training vectors' mean and population deviation.

    A place without deviation is centred only. Vectors should have equal length.
    """
    long = train.select(F.posexplode(F.col(vec_col).cast("array<double>")).alias("k", "x"))
    stats = {r.k: (r.m, r.s) for r in long.groupBy("k").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).collect()}  # one row per place
    places = sorted(stats)
    mean, spread = (F.array(*[F.lit(float(stats[k][j]) or (0.0 if j == 0 else 1.0)) for k in places]) for j in (0, 1))
    x = F.zip_with(F.zip_with(F.col(vec_col).cast("array<double>"), mean, lambda v, m: v - m), spread, lambda v, s: v / s)
    return df.withColumn(vec_col, x)
