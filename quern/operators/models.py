"""Learned scorers over feature vectors: thin fits of Spark ML, plus calibration."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import boosting
from quern.operators.evaluate import logit, sigmoid
from quern.operators.neighbours import BLOCK_BYTES, search

#: Bytes of query vectors that meet a cell of rows at once in ``nearest``.
QUERY_BYTES = BLOCK_BYTES


def fit(df: DataFrame, columns: list[str], kind: str = "logistic", y: str = "y", seed: int = 7702):
    """A fitted model: logistic, forest, boosted or svm; boosted trees draw equal rows alike."""
    if kind == "boosted":
        return boosting.fit(df, columns, F.xxhash64(*columns), y, seed=seed)
    model = {
        "logistic": lambda: LogisticRegression(featuresCol="scaled", labelCol=y, maxIter=100, regParam=1e-3),
        "forest": lambda: RandomForestClassifier(featuresCol="raw", labelCol=y, numTrees=300, seed=seed),
        "svm": lambda: LinearSVC(featuresCol="scaled", labelCol=y, maxIter=100, regParam=1e-3),
    }[kind]()
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), model]).fit(df)


def score(model, df: DataFrame) -> DataFrame:
    """``df`` with ``score``: the positive probability, or the margin where a model has none."""
    if isinstance(model, boosting.Boosted):
        return model.score(df).select(*df.columns, F.get("scores", F.lit(0)).alias("score"))
    out = model.transform(df)
    source = "probability" if "probability" in out.columns else "rawPrediction"
    return out.withColumn("score", vector_to_array(source)[1]).select(*df.columns, "score")


def platt(df: DataFrame, y: str = "y"):
    """A logistic fit on the score's logit; use ``score`` with it."""
    from pyspark.ml.feature import SQLTransformer

    prepare = SQLTransformer(statement="SELECT *, ln(greatest(least(score, 1 - 1e-6), 1e-6) / (1 - greatest(least(score, 1 - 1e-6), 1e-6))) AS __l FROM __THIS__")
    return Pipeline(stages=[prepare, VectorAssembler(inputCols=["__l"], outputCol="__v"), LogisticRegression(featuresCol="__v", labelCol=y)]).fit(df)


def calibrated(train: DataFrame, hold: DataFrame, columns: list[str], kind: str = "svm", y: str = "y", seed: int = 7702):
    """A function that scores rows by a model whose margin or probability is passed through a logistic
    fit on rows that the model didn't see; use it for the SVM, whose margin is no probability."""
    model = fit(train, columns, kind, y, seed)
    own = score(model, hold).withColumnRenamed("score", "__margin")
    link = Pipeline(stages=[VectorAssembler(inputCols=["__margin"], outputCol="__v"), LogisticRegression(featuresCol="__v", labelCol=y)]).fit(own)

    def scored(df: DataFrame) -> DataFrame:
        return score(link, score(model, df).withColumnRenamed("score", "__margin")).drop("__margin")

    return scored


def isotonic(df: DataFrame, y: str = "y"):
    """A monotone fit of the label on the score."""
    return Pipeline(stages=[VectorAssembler(inputCols=["score"], outputCol="__v"), IsotonicRegression(featuresCol="__v", labelCol=y, predictionCol="calibrated")]).fit(df)


def temperature(df: DataFrame, y: str = "y", grid: tuple[float, ...] = tuple(np.geomspace(0.25, 4, 33))) -> float:
    """The temperature of least log loss on a grid, in one pass."""
    losses = []
    for k, t in enumerate(grid):
        p = F.greatest(F.least(sigmoid(logit(F.col("score")) / float(t)), F.lit(1 - 1e-12)), F.lit(1e-12))
        losses.append(F.avg(-F.when(F.col(y) == 1, F.log(p)).otherwise(F.log(1 - p))).alias(f"l{k}"))
    row = df.agg(*losses).first()
    return float(grid[min(range(len(grid)), key=lambda k: row[k])])


def ensemble(scores: DataFrame, key: str) -> DataFrame:
    return scores.groupBy(key).agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("spread"))


def escalation(df: DataFrame, parts: list[str], train: DataFrame, conflict: str, quantile: float = 0.9) -> DataFrame:
    """risk: sum of z-scored parts, 3 more for a conflict; escalate above a training quantile."""
    from quern.operators.evaluate import z_scores

    def risk(rows: DataFrame) -> DataFrame:
        z = z_scores(rows, train, parts)
        return z.withColumn("risk", sum((F.col(f"z_{p}") for p in parts[1:]), F.col(f"z_{parts[0]}")) + F.when(F.col(conflict), 3.0).otherwise(0.0))

    limit = risk(train).agg(F.percentile("risk", quantile).alias("limit"))
    return risk(df).crossJoin(F.broadcast(limit)).withColumn("escalate", F.col("risk") > F.col("limit"))


def nearest(left: DataFrame, right: DataFrame, id_col: str, vec_col: str, k: int = 1) -> DataFrame:
    """(id, neighbour, distance, rank): each left row's k nearest right rows, exact; see ``neighbours.search``."""
    return search(left, right, id_col, vec_col, k, block_bytes=QUERY_BYTES)[0]
