"""Nulls, empty and long texts, repeats, clashing columns and empty tables, for every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quern.llm import ann, binary, decontaminate, langid, licenses, near_dedup, packing, quality, sharding, substring_dedup
from quern.plans.materialize import scratch_path

BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the quick brown fox jumps over the lazy dog and runs away from it "
LONG = " ".join(f"w{k}x" for k in range(20_000))
ROWS = [
    (1, PROSE * 9, "en", "a"),
    (1, PROSE * 9, "en", "a"),
    (2, PROSE * 9, "en", None),
    (3, None, "en", "a"),
    (4, "", None, "a"),
    (None, PROSE, None, None),
    (None, None, None, None),
    (5, " \n\t ", "fr", "b"),
    (6, "x", "fr", "b"),
    (7, LONG, "en", "b"),
    (8, "le chat noir dort sur le lit et la souris danse dans la cuisine " * 3, "fr", "b"),
    (9, "1234 5678 !!!", "fr", "b"),
    (10, "日本語のテキスト", "ja", "c"),
    (-3, "the  double  space and\x00nul <|endoftext|>", "en", "c"),
]
CLASH = ("id", "n", "h", "i", "u", "key", "keys", "size", "rank", "range", "rep", "component", "score", "length", "piece", "dir", "path", "own", "held_out", "v", "y", "l", "r", "c", "__id", "__lot", "__spans", "f1", "bits", "start", "is_file", "crc", "b", "matched")


def hostile(spark):
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in ROWS], SCHEMA)
    return docs.withColumns({c: F.lit("clash") for c in CLASH})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=((1, 1), (2, 0), (3, 1), (4, 0), (6, 0), (7, 1), (8, 1), (8, 0), (9, None), (None, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int").withColumn("text", F.lit("clash"))


def bench(spark):
    return spark.createDataFrame([(1, PROSE), (1, PROSE), (2, None), (3, ""), (None, "a b c d e f g h i j k l m n")], "item_id long, text string")


def run(name, spark, docs):
    if name == "quality":
        return quality.classify(docs, labels(spark))
    if name == "langid":
        return langid.identify(docs)
    if name == "packing":
        return packing.pack(docs, tokenizer_path=BPE)
    if name == "licenses":
        return licenses.scan(docs, F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    if name == "binary":
        path = scratch_path(spark, "tokens")
        return binary.read_tokens(binary.write_tokens(docs, path, tokenizer_path=BPE), path)
    if name == "substring":
        return substring_dedup.repeated_passages(docs)
    if name == "sharding":
        return sharding.shard(docs)
    if name == "decontaminate":
        return decontaminate.contaminations(docs, bench(spark))
    return near_dedup.near_duplicates(docs)


NAMES = ["quality", "langid", "packing", "licenses", "binary", "substring", "sharding", "decontaminate", "near_dedup"]


@pytest.mark.parametrize("name", NAMES)
def test_hostile_rows(spark, name):
    rows = run(name, spark, hostile(spark)).collect()
    ids = sorted((r.doc_id for r in rows), key=lambda x: (x is not None, x or 0))
    every = sorted((r[0] for r in ROWS), key=lambda x: (x is not None, x or 0))
    if name in ("quality", "langid", "licenses", "sharding", "near_dedup", "binary"):
        assert ids == every
    if name == "packing":
        assert set(ids) == set(every) and sum(r.piece == 0 for r in rows) == len(ROWS)
        assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    if name == "quality":
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    if name == "langid":
        by = {r.doc_id: r for r in rows if r.doc_id is not None}
        assert all(by[k].lang_pred == "und" and by[k].score == 0 and by[k].rejected for k in (3, 4, 5, 9))
    if name == "near_dedup":
        by = {r.doc_id: r for r in rows if r.doc_id is not None}
        assert by[1].component_id == by[2].component_id == 1 and by[1].kept and not by[2].kept
        assert by[3].n_shingles == by[4].n_shingles == by[5].n_shingles == 0 and by[3].kept and by[4].kept
    if name == "substring":
        assert {(r.doc_id, r.source_doc_id) for r in rows} == {(2, 1)}
    if name == "decontaminate":
        assert {r.item_id for r in rows} == {1} and ids == [None, 1, 1, 2]
    if name == "sharding":
        assert all(r.size == len((t or "").encode()) + 16 for r in rows for i, t, *_ in ROWS if i is not None and r.doc_id == i)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, name):
    assert run(name, spark, empty(spark)).collect() == []


@pytest.mark.parametrize("rows", [[], [(1, 1)], [(1, 0), (8, 0)]])
def test_one_class_or_none(spark, rows):
    out = quality.classify(hostile(spark), labels(spark, rows)).collect()
    want = 0.5 if not rows or all(__import__("zlib").crc32(str(i).encode()) % 3 == 1 for i, _ in rows) else float(rows[0][1])
    assert all(abs(r.score - want) < 1e-9 for r in out)


def test_nothing_to_learn_languages_from(spark):
    out = langid.identify(hostile(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert all(r.lang_pred == "und" and r.score == 0 and r.rejected for r in out)


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0, 0.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0]), (None, [1.0, 1.0]), (9, []), (100, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("id", "v", "dim", "score", "rank")})
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(v, v.where("vec_id % 100 = 0")).collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 100, 0.0), (0, 3, 8, 1.0), (100, 1, 0, 0.0), (100, 2, 1, 0.0), (100, 3, 8, 1.0)]
    assert ann.nearest(v.limit(0), v.limit(0)).collect() == []


def test_cut_and_drop_keep_columns(spark):
    docs = hostile(spark)
    found = substring_dedup.repeated_passages(docs)
    out = substring_dedup.cut_passages(docs.drop("__spans", "__id"), found)
    assert out.columns == docs.drop("__spans", "__id").columns and out.count() == len(ROWS) - 1
    assert decontaminate.drop_contaminated(docs, bench(spark)).columns == docs.columns
    assert decontaminate.drop_contaminated(docs, bench(spark)).count() == len(ROWS) - 4
