"""The pipeline's stages on nulls, repeated rows, long texts, clashing columns and empty tables."""

import pytest

import corpus_pipeline as p
from tests.llm.test_edges import ROWS, empty, hostile


@pytest.mark.parametrize("name", [n for n, _ in p.STAGES])
def test_hostile_and_empty_tables(spark, sf, name):
    stage = dict(p.STAGES)[name]
    for docs in (hostile(spark), empty(spark)):
        out = stage(spark, docs, sf)
        rows = out.collect()
        if name == "best_fit_packing":
            assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        else:
            assert out.columns == docs.columns and len(rows) <= docs.count()
        if docs.isEmpty():
            assert rows == []


def test_what_stays_of_hostile_rows(spark, sf):
    stages = dict(p.STAGES)
    docs = hostile(spark)
    texts = [r[1] for r in ROWS]
    kept = sorted((r.text for r in stages["near_duplicates"](spark, docs, sf).collect()), key=str)
    once = {t for t in texts if t is not None and t.split()}
    assert kept == sorted([*once, *(t for t in texts if t is None or not t.split())], key=str)
    kept = stages["decontamination"](spark, docs, sf)
    assert kept.count() == len(ROWS)
    kept = [r.text for r in stages["language_id"](spark, docs, sf).collect()]
    assert all(t and any(map(str.isalpha, t)) for t in kept)
    packed = stages["best_fit_packing"](spark, docs, sf)
    assert packed.where("piece = 0").count() == len(ROWS)


def test_whole_run(spark, sf, tmp_path):
    for name, rows in (("empty", empty(spark)), ("hostile", hostile(spark))):
        rows.write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"file://{tmp_path}/{name}/benchmark.parquet")
    assert p.run(spark, f"file://{tmp_path}/empty").collect() == []
    assert p.run(spark, f"file://{tmp_path}/hostile").count() > 0
