"""Language identification by nearest centroid.

A text is a vector of hashed letter trigrams, weighted by TF-IDF and scaled to
length one. Each language has several centroids, clustered by cosine; a text
takes the language of the nearest one and is rejected where even that is too
far for a text with so many trigrams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import bounded_batches, chunks, crc_mod, hash01, small_ids, summed, trim
from quern.plans.materialize import materialize

BITS = 12
DIM = 1 << BITS
#: Labelled rows per language on which centroids are clustered, and centroids of each.
SAMPLE, CENTROIDS = 1500, 4
#: A text is rejected below SLACK times the smallest cosine of sampled texts with
#: as many trigrams (by powers of two), or below FLOOR where few were sampled.
SLACK, FLOOR = 0.6, 0.02
_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def _counts(texts: list[str]) -> np.ndarray:
    """Trigram counts of texts, one row each. A trigram's middle is a letter."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    b = _LETTER[np.frombuffer(b" " + b"  ".join(raw) + b" ", np.uint8)]
    code = b[:-2].astype(np.uint32) << 16 | b[1:-1].astype(np.uint32) << 8 | b[2:]
    code = code * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)
    own = np.repeat(np.arange(len(raw)), [len(t) + 2 for t in raw])[: len(code)]
    keep = b[1:-1] != 32
    return np.bincount(own[keep] * DIM + code[keep], minlength=len(raw) * DIM).reshape(len(raw), DIM)


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """Counts of a few texts at a time and the index of the first."""
    flat = ["" if t is None else t for t in texts]
    for i, j in chunks(flat):
        for k in range(i, j, 256):
            yield k, _counts(flat[k : min(k + 256, j)])


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts.astype(np.float32)) * idf
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(DIM + 1, np.int64)
    for batch in batches:
        for _, counts in _blocks(batch.column(0).to_pylist()):
            total[:DIM] += (counts > 0).sum(0)
            total[DIM] += len(counts)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from spread-out starting rows; empty clusters vanish."""
    start = [0]
    near = x @ x[0]
    for _ in range(min(k, len(x)) - 1):
        start.append(int(near.argmin()))
        near = np.maximum(near, x @ x[start[-1]])
    c = x[start]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = np.stack([x[own == j].sum(0) for j in range(len(c)) if (own == j).any()])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _grade(counts: np.ndarray) -> np.ndarray:
    """The power of two of the number of distinct trigrams."""
    return np.floor(np.log2(np.maximum((counts > 0).sum(1), 1))).astype(int)


def _fit_language(idf: np.ndarray, centroids: int):
    def of(key, table):
        xs, grades = [], []
        for _, counts in _blocks(table.column("text").to_pylist()):
            xs.append(_vectors(counts, idf))
            grades.append(_grade(counts))
        x, grade = np.concatenate(xs), np.concatenate(grades)
        some = x.any(1)
        x, grade = x[some], grade[some]
        if not len(x):
            return pa.table({"lang": pa.array([], pa.string()), "centroids": pa.array([], pa.binary()), "floors": pa.array([], pa.binary())})
        c = cluster(x, centroids)
        best = (x @ c.T).max(1)
        floors = np.full(DIM.bit_length() + 1, FLOOR)
        for g in range(len(floors)):
            if (grade == g).sum() >= 20:
                floors[g] = max(FLOOR, SLACK * best[grade == g].min())
        return pa.table({"lang": [key[0].as_py()], "centroids": pa.array([c.astype(np.float32).tobytes()], pa.binary()), "floors": pa.array([floors.tobytes()], pa.binary())})

    return of


def _predict(langs: list[str], owner: np.ndarray, centroids: np.ndarray, floors: np.ndarray, idf: np.ndarray):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            pred, score, away = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            for i, counts in _blocks(texts) if langs else ():
                x = _vectors(counts, idf)
                near = x @ centroids.T
                best, grade = near.argmax(1), _grade(counts)
                for k in range(len(counts)):
                    t = texts[i + k]
                    if t and any(map(str.isalpha, t)):
                        at = owner[best[k]]
                        pred[i + k] = langs[at]
                        score[i + k] = min(max(float(near[k, best[k]]), 0.0), 1.0)
                        away[i + k] = score[i + k] < floors[at, grade[k]]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(pred), pa.array(score), pa.array(away)], ["id", "held_out", "lang_pred", "score", "rejected"])
        trim()

    return of


_SCHEMA = "id long, held_out boolean, lang_pred string, score double, rejected boolean"


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, folds: int = 4, held_out: int = 2, sample: int = SAMPLE, centroids: int = CENTROIDS) -> DataFrame:
    """Language of each row: (id, held_out, lang_pred, score, rejected).

    Rows with a language learn, but for those whose crc32(id) mod ``folds`` is
    ``held_out``. Document frequencies come from all learning rows; centroids
    from at most about ``sample`` rows of each language, chosen by a hash.
    score is the cosine to the nearest centroid, from 0 to 1. rejected marks
    rows that are farther from it than any sampled row of their length, with
    slack, and rows without a language.

    Null or empty texts and texts without a letter are ``und``, score 0 and
    rejected; so is every row where nothing could be learnt. Rows with a null
    id or null language teach nothing; their held_out is false for a null id.
    Ties go to the first language in order. Repeated rows get equal results.
    Whole texts count, however long. Other columns are ignored.
    """
    src, predict = _learned(docs, id_col, text_col, lang_col, folds, held_out, sample, centroids)
    out = src.select("id", "held_out", "text").mapInArrow(predict, _SCHEMA)
    return out.withColumnRenamed("id", id_col)


def drop_rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, folds: int = 4, held_out: int = 2, sample: int = SAMPLE, centroids: int = CENTROIDS) -> DataFrame:
    """``docs`` without rows that ``identify`` rejects; each row is judged by its own text."""
    _, predict = _learned(docs, id_col, text_col, lang_col, folds, held_out, sample, centroids)
    at, schema = docs.columns.index(text_col), docs.schema

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            own = pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), batch.column(at)], ["id", "held_out", "text"])
            for found in predict(iter([own])):
                yield batch.filter(pc.invert(found.column("rejected")))

    return docs.mapInArrow(of, schema)


def _learned(docs: DataFrame, id_col: str, text_col: str, lang_col: str, folds: int, held_out: int, sample: int, centroids: int):
    """The rows as they are judged, and a function that judges batches of them."""
    spark = docs.sparkSession
    bounded_batches(spark)
    mod = crc_mod(F.col(id_col), folds)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.coalesce(mod == held_out, F.lit(False)).alias("held_out"))
    learn = src.where("not held_out and id is not null and lang is not null and text is not null")
    sizes = materialize(learn.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    langs, owner, model, floors, idf = [], np.zeros(0, int), np.zeros((0, DIM), np.float32), np.zeros((0, 0)), np.ones(DIM, np.float32)
    if not sizes.isEmpty():
        df = summed(learn.select("text").mapInArrow(_document_frequency, "v binary"), DIM + 1)
        idf = (np.log((1 + df[DIM]) / (1 + df[:DIM])) + 1).astype(np.float32)
        # one row per language
        few = learn.join(small_ids(sizes), "lang").where(hash01(F.col("id"), 11) < sample / F.col("n")).select("lang", "text")
        schema = "lang string, centroids binary, floors binary"
        rows = sorted(few.groupBy("lang").applyInArrow(_fit_language(idf, centroids), schema).collect(), key=lambda r: r.lang)
        parts = [np.frombuffer(r.centroids, np.float32).reshape(-1, DIM) for r in rows]
        if rows:
            langs = [r.lang for r in rows]
            owner = np.repeat(np.arange(len(rows)), [len(p) for p in parts])
            model, floors = np.concatenate(parts), np.stack([np.frombuffer(r.floors) for r in rows])
    return src, _predict(langs, owner, model, floors, idf)


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """Languages of all documents."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
