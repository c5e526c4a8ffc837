"""Running sums and ranks over a whole table, by ranges and not in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.materialize import materialize

#: Rows up to which one window is cheaper than ranges; the result is the same.
ONE_WINDOW = 100_000


def running(df: DataFrame, order: list[tuple[str, bool]], values: dict[str, tuple[str | Column, str]], by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with running aggregates, each up to and with its row.

    ``order`` names columns and whether they descend; rows should differ in
    them. ``values`` gives for each new column what is aggregated and how:
    ``sum`` or ``max``. Sums begin anew for each value of ``by``.

    Rows are dealt into ranges of the order, each task aggregates its own
    range, and the totals of earlier ranges (one row per range and group) are
    added. Nulls sort first and count nothing.
    """
    table = materialize(df, "running")
    keys = [*(F.col(b).asc_nulls_first() for b in by), *(F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_first() for c, down in order)]
    fold = {"sum": F.sum, "max": F.max}
    inside = (Window.unboundedPreceding, Window.currentRow)
    if table.limit(ONE_WINDOW + 1).count() <= ONE_WINDOW:
        own = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*keys[len(by) :]).rowsBetween(*inside)
        return table.select("*", *[fold[how](value).over(own).alias(name) for name, (value, how) in values.items()])
    dealt = table.select("*", *[(F.col(v) if isinstance(v, str) else v).alias(f"__v_{n}") for n, (v, _) in values.items()])
    dealt = materialize(dealt.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()), "ranges")
    total = dealt.groupBy("__range", *by).agg(*[fold[how](f"__v_{n}").alias(f"__t_{n}") for n, (_, how) in values.items()])
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select("__range", *[F.col(b).alias(f"__b_{b}") for b in by], *[fold[how](f"__t_{n}").over(before).alias(f"__t_{n}") for n, (_, how) in values.items()])
    own = Window.partitionBy("__range", *by).orderBy(*keys[len(by) :]).rowsBetween(*inside)
    dealt = dealt.select("*", *[fold[how](f"__v_{n}").over(own).alias(n) for n, (_, how) in values.items()])
    on = F.col("__range") == F.col("__r")
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"__b_{b}"))
    out = dealt.join(total.withColumnRenamed("__range", "__r"), on)
    join = {"sum": lambda a, b: F.coalesce(a + b, a, b), "max": F.greatest}
    return out.select(*table.columns, *[join[how](F.col(n), F.col(f"__t_{n}")).alias(n) for n, (_, how) in values.items()])


def ranked(df: DataFrame, order: list[tuple[str, bool]], name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with each row's place in the order, from 1."""
    return running(df, order, {name: (F.lit(1).cast("long"), "sum")}, by)
