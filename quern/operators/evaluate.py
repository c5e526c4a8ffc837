"""Splits, thresholds and metrics of scored rows. Scores group before they rank."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.ranges import ranked, running
from quern.plans.materialize import materialize
from quern.schemas import kind


def _div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(df: DataFrame, y: str = "y", pred: str = "pred", by: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, fpr, f1; a ratio without cases is 0. With a weight, rows count as much as it says."""
    t, p = F.col(y) == 1, F.col(pred) == 1
    n = F.count_if if weight is None else lambda c: F.coalesce(F.sum(F.when(c, F.col(weight).cast("double"))), F.lit(0.0))
    out = df.groupBy(*by).agg(n(t & p).alias("tp"), n(~t & p).alias("fp"), n(t & ~p).alias("fn"), n(~t & ~p).alias("tn"))
    out = out.withColumns({"precision": _div(F.col("tp"), F.col("tp") + F.col("fp")), "recall": _div(F.col("tp"), F.col("tp") + F.col("fn")), "fpr": _div(F.col("fp"), F.col("fp") + F.col("tn"))})
    return out.withColumn("f1", _div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def curve(df: DataFrame, y: str = "y", score: str = "score", by: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """A point per distinct score, highest first: tp, fp (running), pos, neg, precision, recall, fpr.

    Rows are summed per score before the running sums, so ties move together;
    the sums go by ranges of the score, so no task sees all of them.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    point = df.groupBy(*by, F.col(score).alias("score")).agg(F.sum(F.when(F.col(y) == 1, w).otherwise(0.0)).alias("p"), F.sum(F.when(F.col(y) == 1, 0.0).otherwise(w)).alias("n"))
    out = running(point, [("score", True)], {"tp": ("p", "sum"), "fp": ("n", "sum")}, by)
    total = point.groupBy(*by).agg(F.sum("p").alias("pos"), F.sum("n").alias("neg"))
    out = out.join(total, list(by)) if by else out.crossJoin(F.broadcast(total))  # one row
    out = out.select(*by, "score", "p", "n", "tp", "fp", "pos", "neg")
    return out.withColumns({"precision": F.col("tp") / (F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", "pos"), "fpr": F.try_divide("fp", "neg")})


def average_precision(df: DataFrame, y: str = "y", score: str = "score", by: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """Step-wise average precision over tie groups; null without positives."""
    return curve(df, y, score, by, weight).groupBy(*by).agg(F.try_divide(F.sum(F.col("precision") * F.col("p")), F.max("pos")).alias("average_precision"))


def auroc(df: DataFrame, y: str = "y", score: str = "score", by: tuple[str, ...] = ()) -> DataFrame:
    """Area under the ROC curve, ties counting half; null with one class."""
    c = curve(df, y, score, by)
    won = F.col("p") * (F.col("neg") - F.col("fp") + F.col("n") / 2)
    return c.groupBy(*by).agg(F.try_divide(F.sum(won), F.max("pos") * F.max("neg")).alias("auroc"))


def max_f1_threshold(df: DataFrame, y: str = "y", score: str = "score", by: tuple[str, ...] = ()) -> DataFrame:
    """(threshold, f1): the highest score among those with the best F1."""
    c = curve(df, y, score, by).withColumn("f1", _div(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("pos")))
    best = F.max(F.struct("f1", "score"))
    return c.groupBy(*by).agg(best.alias("b")).select(*by, F.col("b.score").alias("threshold"), F.col("b.f1").alias("f1"))


def fpr_threshold(df: DataFrame, budget: float, y: str = "y", score: str = "score", by: tuple[str, ...] = ()) -> DataFrame:
    """(threshold, fpr): halfway between the lowest score within the budget and the next lower one.

    Where no score is within the budget, the next number above the highest score.
    """
    c = materialize(curve(df, y, score, by).select(*by, "score", "fpr"), "curve")
    low = c.groupBy(*by).agg(F.min(F.when(F.col("fpr") <= budget, F.struct("score", "fpr"))).alias("l"), F.max("score").alias("top"))
    both = c.join(low, list(by)) if by else c.crossJoin(F.broadcast(low))  # one row
    out = both.groupBy(*by).agg(F.first("l").alias("l"), F.first("top").alias("top"), F.max(F.when(F.col("score") < F.col("l.score"), F.col("score"))).alias("next"))
    t = F.when(F.col("l").isNull(), next_above(F.col("top"))).when(F.col("next").isNull(), F.col("l.score")).otherwise((F.col("l.score") + F.col("next")) / 2)
    return out.select(*by, t.alias("threshold"), F.coalesce("l.fpr", F.lit(0.0)).alias("fpr"))


@F.pandas_udf(kind("double"))
def next_above(x: pd.Series) -> pd.Series:
    """The next greater double."""
    return pd.Series(np.nextafter(x.to_numpy(float), np.inf))


def calibration(df: DataFrame, bins: int = 10, y: str = "y", score: str = "score") -> DataFrame:
    """(bin, n, mean_score, rate): the last bin is closed."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int").alias("bin")
    return df.groupBy(b).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(y).cast("double")).alias("rate"))


def calibration_error(df: DataFrame, bins: int = 10, y: str = "y", score: str = "score") -> DataFrame:
    c = calibration(df, bins, y, score)
    return c.agg((F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("rate"))) / F.sum("n")).alias("ece"))


def brier(df: DataFrame, y: str = "y", score: str = "score", by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(score) - F.col(y)) ** 2).alias("brier"))


def operating_point(df: DataFrame, prevalence: float, y: str = "y", pred: str = "pred") -> DataFrame:
    """Alerts per 1,000 rows and the predictive value at a prevalence."""
    c = confusion(df, y, pred)
    alerts = F.col("recall") * prevalence + F.col("fpr") * (1 - prevalence)
    return c.select((1000 * alerts).alias("alerts_per_1000"), _div(F.col("recall") * prevalence, alerts).alias("ppv"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(40.0)), F.lit(-40.0))))


def logit(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(q / (1 - q))


def warning_tier(score: Column, low: float, high: float) -> Column:
    return F.when(score >= high, "block").when(score >= low, "warn").otherwise("allow")


def deal_alike(first: list[int], second: list[int], a: int, b: int, count: int) -> list[tuple[int, list[int], int]]:
    """Runs (first rank, folds in turn, groups) that deal ``count`` groups, each to the fold where
    ``first``, then ``second`` is least, then the first fold; a group adds ``a`` and ``b`` to them.

    The folds that are lightest take turns until a further one is as light, so there
    are few runs, however many groups.
    """
    out, rank = [], 0
    while count:
        order = sorted(range(len(first)), key=lambda f: (first[f], second[f], f))
        x = order[0]
        turn = [f for f in order if (first[f], second[f], f) < (first[x] + a, second[x] + b, x)]
        some = count
        if len(turn) < len(order):
            y = order[len(turn)]
            rounds, even = divmod(first[y] - first[x], a)
            rounds -= even == 0 and (second[y], y) < (second[x] + rounds * b, x)
            some = min(count, max(rounds, 1) * len(turn))
        out.append((rank, turn, some))
        for at, f in enumerate(turn):
            many = some // len(turn) + (at < some % len(turn))
            first[f], second[f] = first[f] + a * many, second[f] + b * many
        rank, count = rank + some, count - some
    return out


def _dealt(sizes: DataFrame, group: str, plan: DataFrame) -> DataFrame:
    """(group, fold) from (group, __class) and the plan (__class, first, turn, many) by rank within the class."""
    own = ranked(sizes, [("__class", True), (group, False)], "__rank")
    first = own.groupBy("__class").agg(F.min("__rank").alias("__least"))
    own = own.join(first, "__class").withColumn("__at", F.col("__rank") - F.col("__least")).join(F.broadcast(plan), "__class")
    own = own.where((F.col("__at") >= F.col("first")) & (F.col("__at") < F.col("first") + F.col("many")))
    return own.select(group, F.get("turn", ((F.col("__at") - F.col("first")) % F.size("turn")).cast("int")).alias("fold"))


def group_folds(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """(group, fold): largest groups first, each to the lightest fold; ties by name, then fold.

    Only the histogram of group sizes reaches the driver: with n rows there are
    at most sqrt(2 n) sizes. Groups find their fold by their rank in their size.
    """
    sizes = materialize(df.groupBy(group).agg(F.count("*").alias("__class")), "sizes")
    counts = {r["__class"]: r.c for r in sizes.groupBy("__class").agg(F.count("*").alias("c")).collect()}
    load, none = [0] * k, [0] * k
    plan = [(n, *run) for n in sorted(counts, reverse=True) for run in deal_alike(load, none, n, 0, counts[n])]
    return _dealt(sizes, group, df.sparkSession.createDataFrame(plan, "__class long, first long, turn array<int>, many long"))


def stratified_group_folds(df: DataFrame, group: str, y: str, k: int = 5) -> DataFrame:
    """(group, fold): groups with most positives first, each where positives, then negatives, are fewest.

    Groups with as many positives and negatives are dealt by name. Only the
    histogram of such pairs reaches the driver, in which groups of one kind are
    one entry.
    """
    sizes = df.groupBy(group).agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) != 1).alias("n"))
    sizes = materialize(sizes.withColumn("__class", F.struct("p", "n")), "sizes")
    counts = sizes.groupBy("__class").agg(F.count("*").alias("c")).orderBy(F.desc("__class")).collect()
    pos, neg, plan = [0] * k, [0] * k, []
    for r in counts:
        p, n = r["__class"]
        runs = deal_alike(pos, neg, p, n, r.c) if p else deal_alike(neg, pos, n, 0, r.c)
        plan += [(r["__class"], *run) for run in runs]
    kind_ = sizes.schema["__class"].dataType.simpleString()
    table = df.sparkSession.createDataFrame(plan, f"__class {kind_}, first long, turn array<int>, many long")
    return _dealt(sizes.drop("p", "n"), group, table)


def random_folds(df: DataFrame, id_col: str, k: int = 5, seed: int = 7702) -> DataFrame:
    return df.withColumn("fold", F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(k)).cast("int"))


def roles(df: DataFrame, turn: int, k: int = 5) -> DataFrame:
    """train, validation or test by fold, rotated."""
    return df.withColumn("role", F.when(F.col("fold") == turn % k, "test").when(F.col("fold") == (turn + 1) % k, "validation").otherwise("train"))


def leave_family_out(df: DataFrame, fit, score, k: int = 5, y: str = "y") -> DataFrame:
    """Long table of scores with each fold held out in turn and a threshold from its validation fold.

    ``fit(train)`` gives a model and ``score(model, rows)`` adds ``score``.
    """
    out = None
    for turn in range(k):
        parts = roles(df, turn, k)
        model = fit(parts.where("role = 'train'"))
        val, test = (score(model, parts.where(F.col("role") == r)) for r in ("validation", "test"))
        limit = max_f1_threshold(val, y).select("threshold")
        rows = test.crossJoin(F.broadcast(limit)).withColumns({"pred": (F.col("score") >= F.col("threshold")).cast("int"), "turn": F.lit(turn)})
        out = rows if out is None else out.unionByName(rows)
    return out


def blocklist(df: DataFrame, known_bad: DataFrame, key: str) -> DataFrame:
    """score 1 where a key is on the list, else 0."""
    marked = known_bad.select(key).distinct().withColumn("__hit", F.lit(1.0))
    return df.join(marked, key, "left").withColumn("score", F.coalesce("__hit", F.lit(0.0))).drop("__hit")


def source_weights(df: DataFrame, sid: str) -> DataFrame:
    return df.withColumn("weight", 1 / F.count("*").over(Window.partitionBy(sid)))


def z_scores(df: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled by a training table's mean and population deviation."""
    stats = train.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.crossJoin(F.broadcast(stats))  # one row
    return out.select(*df.columns, *[((F.col(c) - F.col(f"__m_{c}")) / (F.col(f"__s_{c}") + 1e-9)).alias(f"z_{c}") for c in columns])


def rule_score(df: DataFrame, column: str) -> DataFrame:
    """score 1 where a count or flag is above zero, else 0: the name and structure rules."""
    return df.withColumn("score", F.when(F.col(column).cast("double") > 0, 1.0).otherwise(0.0))


def oracle_score(df: DataFrame, label: str, bad: str) -> DataFrame:
    """score 1 where the label is the given one, else 0."""
    return df.withColumn("score", F.when(F.col(label) == bad, 1.0).otherwise(0.0))


def condition_grid(df: DataFrame, condition: str, by: tuple[str, ...] = (), y: str = "y", score: str = "score", pred: str = "pred") -> DataFrame:
    """Confusion counts, rates and average precision of each condition (and ``by``) in one pass each."""
    keys = (*by, condition)
    return confusion(df, y, pred, keys).join(average_precision(df, y, score, keys), list(keys))


def condition_deltas(grid: DataFrame, condition: str, base: str, values: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Each condition's values less those of the base condition, beside the values: <value>_delta."""
    first = grid.where(F.col(condition) == base).select(*by, *[F.col(v).alias(f"__{v}") for v in values])
    out = grid.join(first, list(by)) if by else grid.crossJoin(F.broadcast(first))  # one row
    return out.select(*by, condition, *values, *[(F.col(v) - F.col(f"__{v}")).alias(f"{v}_delta") for v in values])
