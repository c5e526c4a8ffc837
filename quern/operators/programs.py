"""Operators on instruction tables and on rows that describe programs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import evaluate, models


def with_addresses(instr: DataFrame, id_col: str) -> DataFrame:
    """``pc`` computed again as the sizes of all instructions before."""
    before = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return instr.withColumn("pc", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("int"))


def push_positions(instr: DataFrame, id_col: str) -> DataFrame:
    """(id, pos, width, start, end): the bytes of each PUSH's immediate, a cut one as far as it goes."""
    return instr.where("token = 'PUSH'").select(id_col, "pos", (F.col("code") - 0x5F).alias("width"), (F.col("pc") + 1).alias("start"), (F.col("pc") + F.col("size")).alias("end"))


def block_numbers(instr: DataFrame, id_col: str) -> DataFrame:
    """Instructions with the number of their basic block."""
    own = Window.partitionBy(id_col).orderBy("pos")
    ends = F.lag("token").over(own).isin("STOP", "RETURN", "REVERT", "INVALID", "SELFDESTRUCT", "JUMP", "JUMPI")
    starts = F.coalesce((F.col("token") == "JUMPDEST") | ends, F.lit(False)) & (F.col("pos") > 0)
    return instr.withColumn("block", F.sum(starts.cast("int")).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def direct_jumps(instr: DataFrame, id_col: str) -> DataFrame:
    """(id, pc, target): jumps whose target is pushed just before and is a JUMPDEST."""
    own = Window.partitionBy(id_col).orderBy("pos")
    j = instr.withColumns({"__t": F.lag("token").over(own), "__i": F.lag("immediate").over(own)}).where("token in ('JUMP', 'JUMPI') and __t = 'PUSH'")
    short = F.length(F.regexp_replace("__i", "^0+", "")) <= 7
    j = j.where(short).select(id_col, "pc", F.conv("__i", 16, 10).cast("int").alias("target"))
    dest = instr.where("token = 'JUMPDEST'").select(id_col, F.col("pc").alias("target"))
    return j.join(dest, [id_col, "target"]).select(id_col, "pc", "target")


def terminal_statistics(stop: Column, size: Column) -> Column:
    """What lies behind the first halt: bytes, share, and whether anything does."""
    behind = F.greatest(size - F.coalesce(stop + 1, size), F.lit(0))
    return F.struct(behind.alias("trailing_bytes"), F.coalesce(F.try_divide(behind, size), F.lit(0.0)).alias("trailing_share"), (behind > 0).alias("has_trailing"), stop.isNull().alias("no_stop"))


def explanations(factors: dict[str, Column]) -> Column:
    """Names of the factors that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in factors.items()]))


def loss_table(profiles: DataFrame, capabilities: DataFrame) -> DataFrame:
    """(profile, capability, loss): each profile's assets that a capability reaches.

    profiles: profile, asset, amount; capabilities: capability, asset, which is a
    fixed dimension: more than 1,000 capabilities are an error. Every profile has
    a row for each.
    """
    named = capabilities.select("capability").distinct().limit(1001).collect()
    if len(named) > 1000:
        raise ValueError("more than 1000 capabilities")
    all_ = F.array(*[F.lit(r.capability) for r in named]).cast("array<string>")
    pairs = profiles.select("profile").distinct().withColumn("capability", F.explode(all_))
    hit = profiles.join(capabilities, "asset").groupBy("profile", "capability").agg(F.sum("amount").alias("loss"))
    return pairs.join(hit, ["profile", "capability"], "left").withColumn("loss", F.coalesce("loss", F.lit(0)))


def leakage(train: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    """(key, shared): values of each key that both sides hold; all must be 0."""
    out = None
    for k in keys:
        row = train.select(k).distinct().join(test.select(k).distinct(), k, "left_semi").agg(F.count("*").alias("shared")).select(F.lit(k).alias("key"), "shared")
        out = row if out is None else out.unionByName(row)
    return out


def shortcut_diagnostics(train: DataFrame, test: DataFrame, feature_sets: dict[str, list[str]], kinds: tuple[str, ...] = ("logistic",), y: str = "y") -> DataFrame:
    """(features, model, average_precision, auroc) of models that see trivial features only."""
    out = None
    for name, columns in feature_sets.items():
        for kind in kinds:
            s = models.score(models.fit(train, columns, kind, y), test)
            row = evaluate.average_precision(s, y).crossJoin(evaluate.auroc(s, y)).select(F.lit(name).alias("features"), F.lit(kind).alias("model"), "average_precision", "auroc")
            out = row if out is None else out.unionByName(row)
    return out


def one_hot(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return df.withColumns({f"{column}_{v}": (F.col(column) == v).cast("int") for v in values})


def designator_chain(codes: DataFrame, edges: DataFrame) -> DataFrame:
    """(target, n_accounts, class): delegates by in-degree with the class of their code."""
    n = edges.groupBy("target").agg(F.count_distinct("account").alias("n_accounts"))
    return n.join(codes.select(F.col("address").alias("target"), "class"), "target", "left")


def error_concentration(df: DataFrame, error: str, escalated: str) -> DataFrame:
    """Error rate among escalated rows over that among all."""
    rate = F.avg(F.when(F.col(escalated), F.col(error).cast("double")))
    return df.agg(F.try_divide(rate, F.avg(F.col(error).cast("double"))).alias("ratio"), F.avg(F.col(escalated).cast("double")).alias("escalated_share"))
