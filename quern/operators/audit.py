"""Invariants, ledgers and descriptive blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_invariants(df: DataFrame, family: str, fold: str, code: str, y: str) -> DataFrame:
    """Counts that must all be zero: families or codes in two folds, codes with two labels."""
    many = lambda key, value: df.groupBy(key).agg(F.count_distinct(value).alias("n")).agg(F.count_if(F.col("n") > 1))
    out = many(family, fold).toDF("families_in_folds")
    return out.crossJoin(many(code, fold).toDF("codes_in_folds")).crossJoin(many(code, y).toDF("codes_with_labels"))


def corpus_block(df: DataFrame, key: str, size: str, chain: str) -> DataFrame:
    """One row: rows, distinct codes, copies, cross-chain codes and sizes."""
    g = df.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(chain).alias("c"))
    a = g.agg(F.sum("n").alias("rows"), F.count("*").alias("codes"), F.count_if(F.col("n") > 1).alias("copied_codes"), F.count_if(F.col("c") > 1).alias("cross_chain_codes"), F.max("n").alias("largest_group"))
    return a.crossJoin(df.agg(F.min(size).alias("min_size"), F.max(size).alias("max_size"), F.avg(size).alias("mean_size")))


def size_buckets(df: DataFrame, group: str) -> DataFrame:
    """How many groups have 1, 2, 3-5, 6-10 or more members."""
    n = F.col("n")
    g = df.groupBy(group).agg(F.count("*").alias("n"))
    return g.agg(F.count_if(n == 1).alias("b1"), F.count_if(n == 2).alias("b2"), F.count_if(n.between(3, 5)).alias("b3_5"), F.count_if(n.between(6, 10)).alias("b6_10"), F.count_if(n > 10).alias("b_more"))


def family_block(df: DataFrame, family: str, label: str) -> DataFrame:
    """(label, rows, families, singletons, largest) of each class: how its rows fall into families."""
    g = df.groupBy(label, family).agg(F.count("*").alias("n"))
    return g.groupBy(label).agg(F.sum("n").alias("rows"), F.count("*").alias("families"), F.count_if(F.col("n") == 1).alias("singletons"), F.max("n").alias("largest"))


def stage_ledger(stages: list[tuple[str, DataFrame]], y: str) -> DataFrame:
    """(stage, rows, positives) of a construction, stage by stage."""
    out = None
    for k, (name, df) in enumerate(stages):
        row = df.agg(F.count("*").alias("rows"), F.count_if(F.col(y) == 1).alias("positives")).select(F.lit(k).alias("step"), F.lit(name).alias("stage"), "rows", "positives")
        out = row if out is None else out.unionByName(row)
    return out


def agreement_of_runs(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows in both, largest and mean absolute difference, rows that only one has."""
    x, y = a.select(*keys, F.col(value).alias("x")), b.select(*keys, F.col(value).alias("y"))
    j = x.join(y, keys, "full")
    d = F.abs(F.col("x") - F.col("y"))
    return j.agg(F.count(d).alias("rows"), F.max(d).alias("max_diff"), F.avg(d).alias("mean_diff"), F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("unmatched"))


def contamination(df: DataFrame, reference: DataFrame, family: str) -> DataFrame:
    """How many rows share a family with a reference set."""
    hit = reference.select(family).distinct().withColumn("__hit", F.lit(1))
    j = df.join(hit, family, "left")
    return j.agg(F.count("*").alias("rows"), F.count("__hit").alias("contaminated"), F.avg(F.when(F.col("__hit").isNotNull(), 1.0).otherwise(0.0)).alias("share"))


def preserved(before: DataFrame, after: DataFrame, key: str, tokens: str) -> DataFrame:
    """Rows whose token sequence an edit left as it was.

    Sequences are longer than the file they are made from tells, so they are never broadcast.
    """
    j = before.select(key, F.col(tokens).alias("x")).join(after.select(key, F.col(tokens).alias("y")).hint("merge"), key)
    return j.agg(F.count("*").alias("rows"), F.count_if(F.col("x") == F.col("y")).alias("preserved"))
