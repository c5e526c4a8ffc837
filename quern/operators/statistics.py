"""Intervals, agreement and tests."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.draws import poisson
from quern.operators.ranges import ranked, running
from quern.plans.materialize import materialize
from quern.schemas import kind


def _gamma_tail(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function, by its series or its continued fraction."""
    if x <= 0 or a <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * scale
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for k in range(1, 10_000):
        step = -k * (k - a)
        b += 2
        d = step * d + b
        c = b + step / c
        d = 1 / (d or 1e-300)
        c = c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * scale


@F.pandas_udf(kind("double"))
def chi_square_tail(statistic: pd.Series, dof: pd.Series) -> pd.Series:
    """Chance of a chi-square value at least as large; null where the statistic or the degrees are."""
    return pd.Series([None if pd.isna(s) or pd.isna(k) or k < 1 else min(1.0, max(0.0, _gamma_tail(float(k) / 2, float(s) / 2))) for s, k in zip(statistic, dof)], dtype="float64")


def normal_tail(z: Column) -> Column:
    """Chance that a standard normal value is farther from zero than z."""
    return chi_square_tail(z * z, F.lit(1))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Lower and upper end of the score interval; null without cases."""
    p = F.try_divide(k, n)
    mid = F.try_divide(p + F.lit(z * z) / (2 * n), 1 + F.lit(z * z) / n)
    half = F.try_divide(z * F.sqrt(F.try_divide(p * (1 - p), n) + F.lit(z * z) / (4 * n * n)), 1 + F.lit(z * z) / n)
    return F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two raters beyond chance; rows with a missing rating don't count."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("n"))
    total = pairs.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"))
    left, right = pairs.groupBy("x").agg(F.sum("n").alias("nx")), pairs.groupBy("y").agg(F.sum("n").alias("ny"))
    chance = left.join(right, left["x"] == right["y"]).agg(F.coalesce(F.sum(F.col("nx") * F.col("ny")), F.lit(0)).alias("c"))
    po, pe = F.col("same") / F.col("t"), F.col("c") / (F.col("t") * F.col("t"))
    return total.crossJoin(chance).select(po.alias("observed"), pe.alias("expected"), F.try_divide(po - pe, 1 - pe).alias("kappa"))


def fleiss_kappa(ratings: DataFrame, item: str, rating: str) -> DataFrame:
    """Agreement of equally many raters of each item, from one row per rating."""
    n = ratings.groupBy(item, rating).agg(F.count("*").alias("n"))
    own = n.groupBy(item).agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("agree"), F.sum("n").alias("r"))
    mean = own.agg(F.avg(F.col("agree") / (F.col("r") * (F.col("r") - 1))).alias("p"), F.sum("r").alias("all"))
    share = n.groupBy(rating).agg(F.sum("n").alias("m")).agg(F.sum(F.col("m") * F.col("m")).alias("s"))
    pe = F.col("s") / (F.col("all") * F.col("all"))
    return mean.crossJoin(share).select(F.try_divide(F.col("p") - pe, 1 - pe).alias("kappa"))


def majority(ratings: DataFrame, item: str, rating: str) -> DataFrame:
    """The rating of more than half, else no_majority."""
    n = ratings.groupBy(item, rating).agg(F.count("*").alias("n"))
    top = n.groupBy(item).agg(F.sum("n").alias("all"), F.max(F.struct(F.col("n"), F.col(rating).alias("v"))).alias("t"))
    return top.select(item, F.when(F.col("t.n") * 2 > F.col("all"), F.col("t.v").cast("string")).otherwise("no_majority").alias("majority"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two partitions, from counts of the contingency table."""
    pick = lambda c: c * (c - 1) / 2
    cell = df.groupBy(a, b).agg(F.count("*").alias("n"))
    both = cell.agg(F.sum(pick(F.col("n"))).alias("ij"), F.sum("n").alias("t"))
    side = lambda c, name: cell.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(pick(F.col("n"))).alias(name))
    out = both.crossJoin(side(a, "i")).crossJoin(side(b, "j"))
    want = F.col("i") * F.col("j") / pick(F.col("t"))
    return out.select(F.try_divide(F.col("ij") - want, (F.col("i") + F.col("j")) / 2 - want).alias("ari"))


def ks_two_sample(df: DataFrame, value: str, group: str, first, second) -> DataFrame:
    """Largest distance of two groups' distribution functions, over distinct values."""
    p = df.where(F.col(group).isin(first, second)).groupBy(F.col(value).alias("v")).agg(F.count_if(F.col(group) == first).alias("a"), F.count_if(F.col(group) == second).alias("b"))
    run = running(p, [("v", False)], {"ra": ("a", "sum"), "rb": ("b", "sum")})
    all_ = p.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    gap = F.abs(F.try_divide("ra", "na") - F.try_divide("rb", "nb"))
    return run.crossJoin(F.broadcast(all_)).agg(F.max(gap).alias("statistic"))  # one row


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Statistic, degrees of freedom and p-value of independence of two columns.

    The cells that no row has add their expectations, which are the total less
    those of the others: so only cells that occur are looked at.
    """
    cell = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    cell = materialize(cell, "cells")
    left = cell.groupBy(a).agg(F.sum("n").alias("na"))
    right = cell.groupBy(b).agg(F.sum("n").alias("nb"))
    total = cell.agg(F.sum("n").alias("t"), F.count_distinct(a).alias("ka"), F.count_distinct(b).alias("kb"))
    want = F.col("na") * F.col("nb") / F.col("t")
    full = cell.join(left, a).join(right, b).crossJoin(F.broadcast(total))  # one row
    out = full.agg((F.sum((F.col("n") - want) * (F.col("n") - want) / want) + F.max("t") - F.sum(want)).alias("statistic"), ((F.max("ka") - 1) * (F.max("kb") - 1)).alias("dof"))
    return out.withColumn("p_value", chi_square_tail(F.col("statistic"), F.col("dof")))


def kruskal_wallis(df: DataFrame, value: str, group: str) -> DataFrame:
    """H with correction for ties; ranks come from counts of distinct values."""
    v = df.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    v = running(v, [("v", False)], {"upto": ("c", "sum")}).select("v", "c", (F.col("upto") - F.col("c") + (F.col("c") + 1) / 2).alias("rank"))
    ties = v.agg(F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("ties"), F.sum("c").alias("n"))
    g = df.join(v, df[value] == v["v"]).groupBy(group).agg(F.sum("rank").alias("r"), F.count("*").alias("m"))
    s = g.agg(F.sum(F.col("r") * F.col("r") / F.col("m")).alias("s"), F.count("*").alias("k")).crossJoin(ties)
    h = 12 / (F.col("n") * (F.col("n") + 1)) * F.col("s") - 3 * (F.col("n") + 1)
    n3 = F.col("n") * F.col("n") * F.col("n") - F.col("n")
    out = s.select((h / (1 - F.col("ties") / n3)).alias("h"), (F.col("k") - 1).alias("dof"))
    return out.withColumn("p_value", chi_square_tail(F.col("h"), F.col("dof")))


def holm(p: DataFrame, key: str, value: str) -> DataFrame:
    """Step-down adjusted p-values."""
    m = p.agg(F.count("*").alias("__m"))
    own = ranked(p, [(value, False), (key, False)], "__k").crossJoin(F.broadcast(m))  # one row
    own = own.withColumn("__raw", F.least(F.lit(1.0), F.col(value) * (F.col("__m") - F.col("__k") + 1)))
    return running(own, [("__k", False)], {"adjusted": ("__raw", "max")}).drop("__raw", "__k", "__m")


def _replicates(rows: DataFrame, size: int, reps: int, chunk: int, seed: int) -> DataFrame:
    """(rep, k, v): sums of the values of the drawn units, from rows (h: a unit's hash, v: its ``size`` values).

    Each task draws for its own units and keeps one sum per replicate of a
    chunk; replicates are summed over tasks afterwards. No table of draws
    exists, and results don't depend on partitions.
    """
    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((reps, size))
        for pdf in frames:
            if len(pdf):
                v, h = np.stack(pdf["v"]).astype(float), pdf["h"].to_numpy()
                for i in range(0, reps, chunk):
                    total[i : i + chunk] += poisson(h[:, None], seed, np.arange(i, min(i + chunk, reps))).T @ v
        yield pd.DataFrame({"rep": np.arange(reps), "v": list(total)})

    drawn = rows.mapInPandas(draw, "rep long, v array<double>").select("rep", F.posexplode("v").alias("k", "x"))
    return drawn.groupBy("rep", "k").agg(F.sum("x").alias("x")).groupBy("rep").agg(F.map_from_entries(F.collect_list(F.struct("k", "x"))).alias("v"))


def _summed_units(df: DataFrame, unit: str, strata: str | None, values: list[Column]) -> DataFrame:
    """(h, v) of each unit; with strata, units of different ones are drawn apart."""
    keys = [F.col(unit).cast("string")] + ([F.col(strata).cast("string")] if strata else [])
    sums = df.groupBy(F.xxhash64(*keys).alias("h"), *[F.col(c).alias(f"__{c}") for c in [unit, *([strata] if strata else [])]]).agg(*[F.sum(x.cast("double")).alias(f"__v{k}") for k, x in enumerate(values)])
    return sums.select("h", F.array(*[F.coalesce(f"__v{k}", F.lit(0.0)) for k in range(len(values))]).alias("v"))


def _interval(reps: DataFrame, point: DataFrame, stats: dict[str, Column]) -> DataFrame:
    """(metric, estimate, low, high, below): percentile intervals and the share of replicates at or below zero."""
    out = None
    for name, value in stats.items():
        q = reps.select(value.alias("x")).agg(F.percentile("x", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.avg((F.col("x") <= 0).cast("double")).alias("below"))
        row = point.select(value.alias("estimate")).crossJoin(q).select(F.lit(name).alias("metric"), "estimate", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "below")  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def paired_bootstrap(df: DataFrame, unit: str, y: str = "y", a: str = "pred_a", b: str = "pred_b", reps: int = 10_000, chunk: int = 500, seed: int = 7702, strata: str | None = None) -> DataFrame:
    """Recall and false positive rate of two models, and their differences, when whole units are drawn again.

    ``unit`` is a row's id (independent rows) or its family (clusters); with
    ``strata`` units are drawn within folds. Returns (metric, estimate, low,
    high, below); metrics are recall_a, recall_b, recall_diff and the same of
    fpr. Units are drawn by Poisson weights of mean one.
    """
    pos, hit = F.col(y) == 1, lambda c: F.col(c) == 1
    as_ = lambda c: F.when(c, 1.0).otherwise(0.0)
    values = [as_(pos), as_(~pos), as_(pos & hit(a)), as_(pos & hit(b)), as_(~pos & hit(a)), as_(~pos & hit(b))]
    rows = materialize(_summed_units(df, unit, strata, values), "units")
    reps_ = materialize(_replicates(rows, len(values), reps, chunk, seed), "replicates")
    point = rows.select(F.posexplode("v").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).agg(F.map_from_entries(F.collect_list(F.struct("k", "x"))).alias("v"))
    v = lambda k: F.col("v")[k]
    stats = {}
    for name, top, base in (("recall", (2, 3), 0), ("fpr", (4, 5), 1)):
        x, z = (F.try_divide(v(k), v(base)) for k in top)
        stats |= {f"{name}_a": x, f"{name}_b": z, f"{name}_diff": x - z}
    return _interval(reps_, point, stats)


#: Edges between the ranges of scores in which replicates are summed.
SCORE_RANGES = 32


def precision_bootstrap(df: DataFrame, unit: str, y: str = "y", a: str = "score_a", b: str = "score_b", reps: int = 1000, chunk: int = 100, bins: int | None = None, seed: int = 7702, strata: str | None = None) -> DataFrame:
    """Average precision of two models and the difference when whole units are drawn again; exact, ties in groups.

    Rows are dealt by ranges of their score. One pass sums each replicate's
    weights per range, a second one walks each range from its highest score with
    the sums of the ranges above. Scores that are an edge between ranges are
    ranges of their own, so that many equal scores never come to one task.
    With ``bins``, scores from 0 to 1 count in as many equal bins, whose rows
    tie. Rows with a null label or score count nothing. Units, strata and the
    result are as in ``paired_bootstrap``.
    """
    keys = [F.col(unit).cast("string")] + ([F.col(strata).cast("string")] if strata else [])
    value = lambda c: F.col(c).cast("double") if bins is None else F.least(F.floor(F.col(c) * bins), F.lit(bins - 1)).cast("double")
    rows = df.select(F.xxhash64(*keys).alias("h"), (F.col(y) == 1).alias("y"), value(a).alias("a"), value(b).alias("b")).dropna()
    # rows of a unit that tie are one row
    each = rows.select("h", "y", F.posexplode(F.array("a", "b")).alias("model", "score")).where("not isnan(score)")
    each = each.groupBy("model", "score", "h").agg(F.count_if("y").cast("double").alias("p"), F.count_if(~F.col("y")).cast("double").alias("n"))
    each = materialize(each, "scored")
    share = [k / SCORE_RANGES for k in range(1, SCORE_RANGES)]
    found = each.groupBy("model").agg(F.percentile_approx("score", share).alias("q")).collect()  # two rows
    edges = {r.model: np.unique(r.q) for r in found}
    total = {m: np.zeros((2 * len(e) + 1, 2, reps + 1)) for m, e in edges.items()}
    sums = each.mapInPandas(_range_sums(edges, reps, chunk, seed), "model int, place int, v binary")
    lots = min(SCORE_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    for r in sums.repartition(lots, "model", "place").mapInPandas(_summed_ranges, "model int, place int, v binary").collect():  # one row per range
        total[r.model][r.place] = np.frombuffer(r.v).reshape(2, reps + 1)
    out = {}
    place = F.lit(None).cast("int")
    for m, e in edges.items():  # from the highest scores on: an edge is above the range below it
        at = [F.lit(float(x)) for x in e]
        below = sum([F.when(F.col("score") > x, 2).when(F.col("score") == x, 1).otherwise(0) for x in at], F.lit(0))
        place = F.when(F.col("model") == m, below).otherwise(place)
        above = np.cumsum(total[m][::-1], 0)[::-1] - total[m]
        tied = total[m][1::2] + above[1::2]  # the places of edges
        out[m] = (np.divide(tied[:, 0], tied.sum(1), out=np.zeros_like(tied[:, 0]), where=tied.sum(1) > 0) * total[m][1::2, 0]).sum(0)
        total[m] = (above, total[m][:, 0].sum(0))
    between = each.withColumn("place", place).where("place % 2 = 0")
    between = between.repartition(lots, "model", "place").sortWithinPartitions("model", "place", F.desc("score"))
    walked = between.mapInPandas(_walked({m: above for m, (above, _) in total.items()}, reps, chunk, seed), "model int, v binary").collect()  # one row per task and model
    for r in walked:
        out[r.model] = out[r.model] + np.frombuffer(r.v)
    both = [[None if not pos else float(x / pos) for x, pos in zip(out[m], total[m][1])] if m in out else [None] * (reps + 1) for m in (0, 1)]
    both = df.sparkSession.createDataFrame([(k - 1, p, q) for k, (p, q) in enumerate(zip(*both))], "rep long, a double, b double")
    stats = {"average_precision_a": F.col("a"), "average_precision_b": F.col("b"), "average_precision_diff": F.col("a") - F.col("b")}
    return _interval(both.where("rep >= 0"), both.where("rep < 0"), stats)


def _drawn(h: np.ndarray, reps: int, chunk: int, seed: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Weights (unit, replicate) of some replicates at a time; number 0 is the table as it is."""
    yield slice(0, 1), np.ones((len(h), 1))
    for i in range(0, reps, chunk):
        j = min(i + chunk, reps)
        yield slice(i + 1, j + 1), poisson(h[:, None], seed, np.arange(i, j)).astype(float)


def _range_sums(edges: dict[int, np.ndarray], reps: int, chunk: int, seed: int):
    """(model, place, v): a task's positives and negatives of each range in each replicate."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for pdf in frames:
            for m, own in pdf.groupby("model"):
                score, v = own["score"].to_numpy(), own[["p", "n"]].to_numpy()
                place = np.searchsorted(edges[m], score, "left") + np.searchsorted(edges[m], score, "right")
                some, which = np.unique(place, return_inverse=True)
                for at, w in _drawn(own["h"].to_numpy(), reps, chunk, seed):
                    for k, c in enumerate(some):
                        total.setdefault((m, int(c)), np.zeros((2, reps + 1)))[:, at] += v[which == k].T @ w[which == k]
        yield pd.DataFrame([(m, c, x.tobytes()) for (m, c), x in total.items()], columns=["model", "place", "v"])

    return of


def _summed_ranges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[tuple[int, int], np.ndarray] = {}
    for pdf in frames:
        for m, c, v in zip(pdf["model"], pdf["place"], pdf["v"]):
            total[m, c] = total.get((m, c), 0.0) + np.frombuffer(v)
    yield pd.DataFrame([(m, c, x.tobytes()) for (m, c), x in total.items()], columns=["model", "place", "v"])


def _walked(above: dict[int, np.ndarray], reps: int, chunk: int, seed: int, step: int = 2048):
    """(model, v): what rows sorted by model, range and falling score add to each replicate's sum of precision times positives."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: dict[int, np.ndarray] = {}
        key, upto, tie, group = None, None, None, None

        def close() -> None:  # a group of equal scores counts with all of its rows
            if group is not None:
                upto[:] += group
                out.setdefault(key[0], np.zeros(reps + 1))[:] += np.divide(upto[0], upto.sum(0), out=np.zeros(reps + 1), where=upto.sum(0) > 0) * group[0]

        for pdf in frames:
            for i in range(0, len(pdf), step):
                own = pdf.iloc[i : i + step]
                names = list(zip(own["model"], own["place"], own["score"]))
                new = np.array([0] + [k for k in range(1, len(names)) if names[k] != names[k - 1]])
                sums = np.empty((2, len(new), reps + 1))
                v = own[["p", "n"]].to_numpy()
                for at, w in _drawn(own["h"].to_numpy(), reps, chunk, seed):
                    for j in (0, 1):
                        sums[j][:, at] = np.add.reduceat(v[:, j : j + 1] * w, new, axis=0)
                for k, first in enumerate(new):
                    m, c, s = names[first]
                    if (m, c) == key and s == tie:
                        group = group + sums[:, k]
                        continue
                    close()
                    if (m, c) != key:
                        key, upto = (m, c), above[m][c].copy()
                    tie, group = s, sums[:, k].copy()
        close()
        yield pd.DataFrame([(m, x.tobytes()) for m, x in out.items()], columns=["model", "v"])

    return of


def dunn(df: DataFrame, value: str, group: str) -> DataFrame:
    """(a, b, z, p_value, adjusted) of all pairs of groups by mean ranks, with ties, adjusted step by step."""
    v = df.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    v = materialize(running(v, [("v", False)], {"upto": ("c", "sum")}).select("v", "c", (F.col("upto") - F.col("c") + (F.col("c") + 1) / 2).alias("rank")), "ranks")
    ties = v.agg(F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("ties"), F.sum("c").alias("n"))
    g = materialize(df.join(v, df[value] == v["v"]).groupBy(F.col(group).alias("g")).agg(F.avg("rank").alias("r"), F.count("*").alias("m")), "groups")
    a, b = g.toDF("a", "ra", "ma"), g.toDF("b", "rb", "mb")
    # groups are compared pair by pair: their number, not the rows', is squared
    pairs = a.join(b, F.col("a") < F.col("b")).crossJoin(F.broadcast(ties))  # one row
    n = F.col("n")
    spread = (n * (n + 1) / 12 - F.col("ties") / (12 * (n - 1))) * (1 / F.col("ma") + 1 / F.col("mb"))
    out = pairs.select("a", "b", ((F.col("ra") - F.col("rb")) / F.sqrt(spread)).alias("z"))
    out = materialize(out.withColumn("p_value", normal_tail(F.col("z"))).withColumn("__pair", F.concat_ws("|", "a", "b")), "pairs")
    return holm(out, "__pair", "p_value").select("a", "b", "z", "p_value", "adjusted")


def clustered_bootstrap(df: DataFrame, cluster: str, num: str, den: str, reps: int = 10_000, chunk: int = 500, seed: int = 7702) -> DataFrame:
    """(estimate, low, high) of a ratio of sums when whole clusters are drawn again.

    Clusters are summed first. Each chunk of replicates is a task that draws
    Poisson weights for the clusters by their hash, so no table of draws exists
    and results don't depend on partitions.
    """
    sums = df.groupBy(F.col(cluster).cast("string").alias("c")).agg(F.sum(num).cast("double").alias("a"), F.sum(den).cast("double").alias("b"))
    lots = -(-reps // chunk)
    part = sums.select("a", "b", F.xxhash64("c").alias("h"), F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot"))

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for lot, own in pdf.groupby("lot"):
                w = poisson(own["h"].to_numpy()[:, None], seed, lot * chunk + np.arange(chunk))
                a, b = own["a"].to_numpy() @ w, own["b"].to_numpy() @ w
                yield pd.DataFrame({"rep": lot * chunk + np.arange(chunk), "a": a, "b": b})

    drawn = part.mapInPandas(draw, "rep long, a double, b double").groupBy("rep").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("rep") < reps)
    ends = drawn.agg(F.percentile(F.try_divide("a", "b"), F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    point = sums.agg(F.try_divide(F.sum("a"), F.sum("b")).alias("estimate"))
    return point.crossJoin(ends).select("estimate", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


# Rational approximations of the normal quantile (central, middle and far, from the highest power down),
# and the published polynomials of the test's weights and of its law (from the lowest power up).
_CENTRAL = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608),
    (5226.495278852545925, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0),
)
_MIDDLE = (
    (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0),
)
_FAR = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772),
    (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0),
)
_LAST, _LAST_BUT_ONE = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056), (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_SMALL_MEAN, _SMALL_SPREAD = (0.544, -0.39978, 0.025054, -6.714e-4), (1.3822, -0.77857, 0.062767, -0.0020322)
_MEAN, _SPREAD, _GAMMA = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302), (-2.273, 0.459)


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """The standard normal law's quantile, to the precision of doubles."""
    p = np.asarray(p, float)
    q = p - 0.5
    ratio = lambda parts, x: np.polyval(parts[0], x) / np.polyval(parts[1], x)
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.sqrt(-np.log(np.where(q < 0, p, 1 - p)))
        tail = np.sign(q) * np.where(r <= 5, ratio(_MIDDLE, r - 1.6), ratio(_FAR, r - 5))
        return np.where(np.abs(q) <= 0.425, q * ratio(_CENTRAL, 0.180625 - q * q), tail)


@F.pandas_udf(kind("double"))
def _quantile(p: pd.Series) -> pd.Series:
    return pd.Series(normal_quantile(p.to_numpy()))


def _poly(parts: tuple[float, ...], x: Column) -> Column:
    return sum((F.lit(c) * F.pow(x, F.lit(float(k))) for k, c in enumerate(parts) if k), F.lit(parts[0]))


def shapiro_wilk(df: DataFrame, value: str, group: str) -> DataFrame:
    """(group, n, w, p_value): the test of normality in each group, by Royston's weights and law.

    Ranks go by ranges of the value, so a group may have any size; the published
    law was fitted up to 5,000 values. Null and NaN values count nothing. Groups
    of fewer than three values, or of equal values only, have null results.
    """
    rows = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("x")).where("x is not null and not isnan(x)")
    rows = ranked(rows, [("x", False)], "i", by=("g",))
    size = rows.groupBy(F.col("g").alias("of")).agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.min("x").alias("low"), F.max("x").alias("high"))
    size = materialize(size, "sizes")
    rows = rows.join(size, F.col("g").eqNullSafe(F.col("of"))).drop("of")
    rows = materialize(rows.where("n >= 3 and low < high").withColumn("m", _quantile((F.col("i") - 0.375) / (F.col("n") + 0.25))), "ranks")
    m = lambda k: F.max(F.when(F.col("i") == F.col("n") - k, F.col("m")))
    s = rows.groupBy("g").agg(F.max("n").alias("n"), F.sum(F.col("m") * F.col("m")).alias("mm"), m(0).alias("m0"), m(1).alias("m1"))
    u, root = 1 / F.sqrt(F.col("n").cast("double")), F.sqrt("mm")
    a0 = F.when(F.col("n") == 3, F.lit(math.sqrt(0.5))).otherwise(_poly(_LAST, u) + F.col("m0") / root)
    s = s.withColumns({"a0": a0, "a1": _poly(_LAST_BUT_ONE, u) + F.col("m1") / root})
    two = (F.col("mm") - 2 * F.col("m0") ** 2 - 2 * F.col("m1") ** 2) / (1 - 2 * F.col("a0") ** 2 - 2 * F.col("a1") ** 2)
    one = (F.col("mm") - 2 * F.col("m0") ** 2) / (1 - 2 * F.col("a0") ** 2)
    s = s.withColumn("scale", F.sqrt(F.when(F.col("n") > 5, two).when(F.col("n") > 3, one)))
    near = F.least(F.col("i") - 1, F.col("n") - F.col("i"))  # from the nearer end
    a = F.when(near == 0, F.col("a0")).when((near == 1) & (F.col("n") > 5), F.col("a1")).otherwise(F.abs("m") / F.col("scale"))
    a = F.when(F.col("n") == 3, F.when(near == 0, F.col("a0")).otherwise(0.0)).otherwise(a) * F.signum(F.col("i") - (F.col("n") + 1) / 2)
    rows = rows.join(s.select(F.col("g").alias("__g"), "a0", "a1", "scale"), F.col("g").eqNullSafe(F.col("__g")))
    w = rows.groupBy("g").agg(F.max("n").alias("n"), F.sum(a * (F.col("x") - F.col("mean"))).alias("b"), F.sum((F.col("x") - F.col("mean")) ** 2).alias("ss"))
    w = w.select("g", "n", F.least(F.col("b") ** 2 / F.col("ss"), F.lit(1.0)).alias("w"))
    n, rest = F.col("n").cast("double"), F.log(1 - F.col("w"))
    small = -F.log(_poly(_GAMMA, n) - rest)
    z = F.when(n <= 11, (small - _poly(_SMALL_MEAN, n)) / F.exp(_poly(_SMALL_SPREAD, n))).otherwise((rest - _poly(_MEAN, F.log(n))) / F.exp(_poly(_SPREAD, F.log(n))))
    three = F.greatest(F.lit(6 / math.pi) * (F.asin(F.sqrt("w")) - math.asin(math.sqrt(0.75))), F.lit(0.0))
    upper = F.when(z >= 0, normal_tail(z) / 2).otherwise(1 - normal_tail(z) / 2)  # of two tails
    p = F.when(F.col("w") >= 1, 1.0).when(n == 3, three).when((n <= 11) & (rest >= _poly(_GAMMA, n)), 1e-19).otherwise(upper)
    out = w.select(F.col("g").alias("__g"), "w", p.alias("p_value"))
    return size.join(out, F.col("of").eqNullSafe(F.col("__g")), "left").select(F.col("of").alias(group), "n", "w", "p_value")
