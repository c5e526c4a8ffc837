"""Quality classifier: a linear hinge-loss model over Naive Bayes features.

Indicators of hashed byte n-grams are scaled by the ratio of the classes' log
counts, which come from all labelled rows; dual coordinate descent fits the
hinge loss on a bounded sample; margins become probabilities by a logistic
fit on a part of the sample that the descent did not see.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import as_bytes, bounded_batches, chunks, crc_mod, hash01, summed

BITS = 16
DIM = 1 << BITS
#: Labelled rows of each class, at most about, on which the hinge loss is fitted.
SAMPLE = 6000
#: Labelled ids that may be sent to every executor; more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000


def _codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of 1-, 2- and 3-grams by place (one row each), and each text's start.

    Texts are kept apart by two NUL bytes; an n-gram that begins in a text and
    runs over its end counts as one of that text.
    """
    b = np.frombuffer(b"\x00\x00".join(texts) + b"\x00\x00\x00\x00", np.uint8).astype(np.uint32)
    n = len(b) - 2
    one, two = b[:n] + np.uint32(1), (b[:n] << np.uint32(8) | b[1 : n + 1]) + np.uint32(0x10000)
    three = (b[:n] << np.uint32(16) | b[1 : n + 1] << np.uint32(8) | b[2 : n + 2]) + np.uint32(0x2000000)
    codes = np.stack([x * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS) for x in (one, two, three)])
    return codes, np.concatenate([[0], np.cumsum([len(t) + 2 for t in texts])])


def features(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Sorted distinct codes of each text; none for an empty one."""
    seen = np.zeros(DIM, bool)
    for i, j in chunks(texts):
        codes, at = _codes(texts[i:j])
        for k in range(j - i):
            seen[codes[:, at[k] : at[k] + len(texts[i + k])]] = True
            own = np.flatnonzero(seen).astype(np.int32)
            seen[own] = False
            yield own


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, DIM + 1), np.int64)
    for batch in batches:
        for y, own in zip(batch.column("y").to_pylist(), features(as_bytes(batch.column("text")))):
            total[y, own] += 1
            total[y, DIM] += 1
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])


def log_count_ratio(counts: np.ndarray) -> np.ndarray:
    """log of the classes' smoothed shares of each indicator."""
    p, q = counts[1, :DIM] + 1.0, counts[0, :DIM] + 1.0
    return (np.log(p / p.sum()) - np.log(q / q.sum())).astype(np.float64)


def fit_hinge(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: np.ndarray, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Dual coordinate descent for the hinge loss; the last weight is the bias."""
    w = np.zeros(DIM + 1)
    alpha = np.zeros(len(rows))
    ratio = ratio.astype(np.float64)
    scale = [1 / max(np.sqrt((ratio[own] ** 2).sum()), 1e-12) for own in rows]
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            own = rows[i]
            x = ratio[own] * scale[i]
            grad = y[i] * (w[own] @ x + w[DIM]) - 1
            new = min(max(alpha[i] - grad / 2, 0.0), cost[i])  # each row and the bias have length one
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[own] += step * x
                w[DIM] += step
                alpha[i] = new
    return w


def fit_logistic(m: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic fit with smoothed targets."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -40, 40)))
        g = weight * (p - target)
        h = weight * np.maximum(p * (1 - p), 1e-9)
        grad = np.array([(g * m).sum() + 1e-3 * a, g.sum()])
        hess = np.array([[(h * m * m).sum() + 1e-3, (h * m).sum()], [(h * m).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def _fit(ratio: np.ndarray, share: tuple[float, float]):
    """Weights, slope and intercept from the sampled rows, as one row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, ys, aside = [], [], []
        for batch in batches:
            rows += list(features(as_bytes(batch.column("text"))))
            ys += batch.column("y").to_pylist()
            aside += batch.column("aside").to_pylist()
        y, hold = np.array(ys, int), np.array(aside, bool)
        if len(set(ys)) < 2:
            return
        if len(set(y[~hold])) < 2 or len(set(y[hold])) < 2:
            hold = np.zeros(len(y), bool)
            fit_rows, calibrate = np.arange(len(y)), np.arange(len(y))
        else:
            fit_rows, calibrate = np.flatnonzero(~hold), np.flatnonzero(hold)
        signs = np.where(y[fit_rows] == 1, 1.0, -1.0)
        w = fit_hinge([rows[i] for i in fit_rows], signs, ratio, np.ones(len(fit_rows)))
        v = w[:DIM] * ratio
        m = np.array([_margin(rows[i], v, ratio * ratio, w[DIM]) for i in calibrate])
        weight = np.where(y[calibrate] == 1, 1 / share[1], 1 / share[0])
        a, b = fit_logistic(m, y[calibrate], weight / weight.mean())
        yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()), pa.array([w[DIM]]), pa.array([a]), pa.array([b])], ["v", "bias", "a", "b"])

    return of


def _margin(own: np.ndarray, v: np.ndarray, square: np.ndarray, bias: float) -> float:
    return float(v[own].sum() / max(np.sqrt(square[own].sum()), 1e-12) + bias) if len(own) else float(bias)


def _score(v: np.ndarray, square: np.ndarray, bias: float, a: float, b: float):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.array([_margin(own, v, square, bias) for own in features(as_bytes(batch.column("text")))])
            p = 1 / (1 + np.exp(-np.clip(a * m + b, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    return of


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, folds: int = 3, held_out: int = 1, sample: int = SAMPLE) -> DataFrame:
    """Quality of each row: (id, held_out, score, predicted).

    Labels 0 and 1 are learnt from rows whose crc32(id) mod ``folds`` is not
    ``held_out``; only texts enter a score. Class counts come from all such
    rows, the hinge loss from about ``sample`` of each class, chosen by a hash.

    Null and empty texts have no n-grams and get the score of the bias alone.
    Labels other than 0 and 1 and null ids teach nothing; of several labels of
    one id the smallest counts, and repeated rows of one id count each. With
    one class only, every score is 1 or 0 as that class; with none, 0.5.
    Whole texts count, however long. Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    mod = crc_mod(F.col(id_col), folds)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(mod == held_out, F.lit(False)).alias("held_out"))
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
    known = known.where(F.col("y").isin(0, 1) & (crc_mod(F.col("id"), folds) != held_out)).groupBy("id").agg(F.min("y").alias("y"))
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if sum(sizes.values()) <= BROADCAST_LABELS:
        known = F.broadcast(known)
    learn = src.where("not held_out and id is not null").join(known, "id")
    v, square, bias, a, b = np.zeros(DIM), np.zeros(DIM), 0.0, 0.0, 0.0
    if len(sizes) == 2:
        counts = summed(learn.select("y", "text").mapInArrow(_class_counts, "v binary"), 2 * (DIM + 1)).reshape(2, DIM + 1)
        ratio = log_count_ratio(counts)
        share = tuple(min(1.0, sample / max(sizes[y], 1)) for y in (0, 1))
        at = F.when(F.col("y") == 1, share[1]).otherwise(share[0])
        few = learn.where(hash01(F.col("id"), 5) < at).select("y", "text", (hash01(F.col("id"), 6) < 0.2).alias("aside"))
        # one task: the order of rows is fixed by the hash, so a retry fits the same model
        few = few.repartition(1).sortWithinPartitions(F.xxhash64("text"), "y")
        row = few.mapInArrow(_fit(ratio, share), "v binary, bias double, a double, b double").collect()  # one row, or none
        if row:
            row = row[0]
            v, square, bias, a, b = np.frombuffer(row.v), ratio * ratio, row.bias, row.a, row.b
    elif len(sizes) == 1:
        b = 40.0 if 1 in sizes else -40.0
    out = src.select("id", "held_out", "text").mapInArrow(_score(v, square, bias, a, b), "id long, held_out boolean, score double, predicted int")
    return out.withColumnRenamed("id", id_col)


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Quality of all documents, as labels mark it."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, labels)
