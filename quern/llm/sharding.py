"""Sharding by sampled splitters.

Records are ordered by (hash of text, id, arrival). A sample weighted by size
gives splitters at its quantiles; records are range-partitioned by them, and
ranges that turn out overfull are sampled again and subdivided. The ranges'
exact sizes and each record's place in its range then give the shard whose
share of all bytes the record's middle falls into, so shards differ from an
equal share by about one record.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import bounded_batches, hash01
from quern.plans.materialize import materialize

#: Bytes added to each record; records that a range should hold; ranges per shard, at least.
OVERHEAD, RANGE_ROWS, RANGES_PER_SHARD = 16, 250_000, 4
#: Sampled records per range; times the mean at which a range is overfull; rounds of subdividing.
PER_RANGE, OVERFULL, ROUNDS = 16, 3.0, 6


def _ranged(splitters: list[tuple[int, int, int]]):
    """Number of splitters at or before each record."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("h", "i", "u")))
            at = pa.array(np.fromiter((bisect_right(splitters, k) for k in keys), np.int32, batch.num_rows))
            yield pa.RecordBatch.from_arrays([*batch.columns, at], [*batch.schema.names, "range"])

    return of


def _sample(rows: DataFrame, n: int, seed: int) -> list[tuple[int, int, int]]:
    """At most n keys, each drawn with a chance in proportion to its size, in order."""
    draw = -F.log(1 - hash01(F.col("u"), seed)) / F.col("size")
    return sorted((r.h, r.i, r.u) for r in rows.orderBy(draw, "u").limit(n).select("h", "i", "u").collect())


def _quantiles(sample: list[tuple[int, int, int]], parts: int) -> list[tuple[int, int, int]]:
    return [sample[len(sample) * k // parts] for k in range(1, parts)] if sample else []


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shards: int = 40) -> DataFrame:
    """Shard and slot of each record under the law of near equal bytes.

    Returns (id, size, text_crc32, law, shard, slot, grown_shard). size is the
    text's UTF-8 bytes plus 16; law is ``bytes``; slots run without gaps from 0
    in each shard; grown_shard is null. Equal texts stand next to each other.

    A null text has size 16 and a null crc; an empty one size 16 and crc 0. A
    null id sorts first. Repeated rows are records of their own, and a range of
    them is subdivided like any other. A text longer than a shard's share fills
    a shard that is larger than others; some shards may then be empty, as with
    fewer records than shards. Other columns are ignored. An empty table gives
    an empty result.
    """
    bounded_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    raw = text.cast("binary")
    src = docs.select(F.col(id_col).cast("long").alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).cast("long").alias("crc"), F.xxhash64(text).alias("h"))
    least = F.lit(-(2**63)).cast("long")
    src = materialize(src.select("*", F.coalesce("id", least).alias("i"), F.monotonically_increasing_id().alias("u")), "records")
    n, total = src.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(shards * RANGES_PER_SHARD, -(-n // RANGE_ROWS))
    splitters = sorted(set(_quantiles(_sample(src, ranges * PER_RANGE, 1), ranges)))
    schema = "id long, size long, crc long, h long, i long, u long, range int"
    for turn in range(ROUNDS + 1):
        placed = src.mapInArrow(_ranged(splitters), schema)
        sums = {r.range: (r.b, r.n, r.m) for r in placed.groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("size").alias("m")).collect()}
        mean = total / ranges
        over = [k for k, (b, c, m) in sums.items() if c > 1 and b > OVERFULL * mean + m]
        if not over or turn == ROUNDS:
            break
        more: list[tuple[int, int, int]] = []
        for at in range(0, len(over), 64):  # a bounded sample for a few ranges at a time
            some = over[at : at + 64]
            parts = {k: int(sums[k][0] // mean) + 1 for k in some}
            drawn = _sample(placed.where(F.col("range").isin(some)), sum(parts.values()) * PER_RANGE, 2 + turn)
            by: dict[int, list[tuple[int, int, int]]] = {}
            for key in drawn:
                by.setdefault(bisect_right(splitters, key), []).append(key)
            for k, keys in by.items():
                more += _quantiles(keys, parts[k])
        splitters = sorted({*splitters, *more})
    order = sorted(sums)
    bytes_before = dict(zip(order, accumulate([0, *(sums[k][0] for k in order)])))
    rows_before = dict(zip(order, accumulate([0, *(sums[k][1] for k in order)])))
    base = docs.sparkSession.createDataFrame([(k, bytes_before[k], rows_before[k]) for k in order], "range int, b0 long, r0 long")
    own = Window.partitionBy("range").orderBy("h", "i", "u")
    run = own.rowsBetween(Window.unboundedPreceding, -1)
    out = placed.select("*", F.coalesce(F.sum("size").over(run), F.lit(0)).alias("b"), F.row_number().over(own).alias("r")).join(base, "range")
    middle = (F.col("b0") + F.col("b")) * 2 + F.col("size")
    at = F.least(F.floor(middle.cast("decimal(38,0)") * shards / F.lit(max(2 * total, 1)).cast("decimal(38,0)")).cast("int"), F.lit(shards - 1))
    out = materialize(out.select("id", "size", "crc", at.alias("shard"), (F.col("r0") + F.col("r") - 1).alias("rank")), "placed")
    first = out.groupBy("shard").agg(F.min("rank").alias("first"))
    out = out.join(F.broadcast(first), "shard")  # one row per shard
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_sampled_splitters(spark, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
