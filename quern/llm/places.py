"""Places of rows in their groups, by ranges and not in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.materialize import materialize


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, the place in their group ``g`` from 0, and ``n``, the group's size.

    Rows are dealt into ranges of (g, order), counted there, and numbered from
    the counts of the ranges before; a group may span any number of ranges.
    Nulls come first.
    """
    # written before the ranges are sampled: what the rows are computed from is read once
    rows = materialize(rows, "rows")
    keys = [F.col("g"), *[F.col(c).asc_nulls_first() for c in order]]
    dealt = materialize(rows.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("g", "__range").agg(F.count("*").alias("__c"))
    own = Window.partitionBy("g")
    before = F.coalesce(F.sum("__c").over(own.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("g", "__range", before.alias("__before"), F.sum("__c").over(own).alias("n"))
    inside = Window.partitionBy("g", "__range").orderBy(*keys[1:])
    numbered = dealt.withColumn("__k", F.row_number().over(inside))
    return numbered.join(counts, ["g", "__range"]).withColumn("idx", F.col("__before") + F.col("__k") - 1).drop("__k", "__before", "__range")
