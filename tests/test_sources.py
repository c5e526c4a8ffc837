import gzip

import pytest
from pyspark.sql import functions as F

from quern import schemas
from quern.sources import readers, sinks


def write(tmp_path, name, text):
    p = tmp_path / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)
    return f"file://{p}"


def test_jsonl_keeps_lines_that_end_in_a_comma(spark, tmp_path):
    path = write(tmp_path, "a.jsonl", '{"address": "0x1", "path": "p", "result": [["a", "b"]]},\n\nnot json\n{"address": "0x2", "path": "q", "result": []}\n')
    rows = readers.read_jsonl(spark, path, schemas.RULE_HITS).orderBy("address").collect()
    assert [(r.address, r.result) for r in rows] == [("0x1", [["a", "b"]]), ("0x2", [])]
    assert readers.read_jsonl(spark, path, schemas.RULE_HITS, keep_bad=True).where("_bad is not null").count() == 1


def test_several_objects_in_a_line(spark, tmp_path):
    path = write(tmp_path, "b.jsonl", '{"address": "0x1"}, {"address": "0x2"}{"address": "0x3"},\n{"address": "0x4"}\n')
    assert [r.address for r in readers.read_json_objects(spark, path, schemas.struct("address string")).orderBy("address").collect()] == ["0x1", "0x2", "0x3", "0x4"]


def test_braces_within_texts_and_bad_objects(spark, tmp_path):
    path = write(tmp_path, "c.jsonl", '{"address": "}{"} {"address": "a},{b"},{"address": "x" oops\n[1]\n{"address": "last"}')
    schema = schemas.struct("address string")
    assert sorted(r.address for r in readers.read_json_objects(spark, path, schema).collect()) == ["a},{b", "last", "}{"]
    kept = readers.read_json_objects(spark, path, schema, keep_bad=True).where("_bad is not null").collect()
    assert sorted(r["_bad"] for r in kept) == ['[1]', '{"address": "x" oops']


def test_hex_directory(spark, tmp_path):
    write(tmp_path, "d/eth/0xAA.hex", "6000\n")
    write(tmp_path, "d/bsc/0xBB.hex", "00")
    write(tmp_path, "d/bsc/readme.txt", "x")
    rows = readers.read_hex_directory(spark, f"file://{tmp_path}/d").collect()
    assert sorted(map(tuple, rows)) == [("bsc", "0xBB", "00"), ("eth", "0xAA", "6000")]


def test_addresses(spark, tmp_path):
    good = "0x" + "Ab" * 20
    path = write(tmp_path, "l.txt", f"{good}\n\n{good.lower()}\nnope\n")
    r = readers.address_census(readers.read_address_list(spark, path)).first()
    assert tuple(r) == (3, 2, 1, 1)
    path = write(tmp_path, "m.txt", f'{{"path": "x/eth/{good}.hex"}}\nbare {good} here\nnone\n')
    assert sorted((r.address, r.chain) for r in readers.read_addresses_from_jsonl(spark, path).fillna("").collect()) == [(good.lower(), ""), (good.lower(), "eth")]


def test_csv_and_gzip(spark, tmp_path):
    df = spark.createDataFrame([("a", "eth", "x", "6000")], schemas.CONTRACTS)
    sinks.write_csv(df, f"file://{tmp_path}/c", gzip=True)
    assert readers.read_csv(spark, f"file://{tmp_path}/c", schemas.CONTRACTS).collect() == df.collect()
    assert any(p.suffix == ".gz" for p in (tmp_path / "c").iterdir())
    path = write(tmp_path, "r.tsv", "a\tb\na\tb\nc\td\n")
    assert readers.read_rule_output(spark, path, ["x", "y"]).count() == 2
    with gzip.open(tmp_path / "s.csv.gz", "wt") as f:
        f.write("a,b\n1,True\n")
    assert readers.read_strings(spark, f"file://{tmp_path}/s.csv.gz").dtypes == [("a", "string"), ("b", "string")]


def test_headers_pointers_and_schemas(spark):
    df = spark.createDataFrame([("0x1", "6000")], "` Contract Address ` string, Code string")
    assert readers.rename_headers(df, {"address": ("contract address",), "bytecode": ("code",)}).columns == ["address", "bytecode"]
    with pytest.raises(ValueError, match="no column for chain"):
        readers.rename_headers(df, {"chain": ()})
    with pytest.raises(ValueError, match="pointer"):
        readers.reject_pointer_files(spark.createDataFrame([("version https://git-lfs.github.com/spec/v1",)], "a string"), "a")
    with pytest.raises(ValueError, match="missing columns: x"):
        schemas.require(df, "x")


def test_cache_and_retry(spark):
    want = spark.createDataFrame([("e", "1"), ("e", "2")], "chain string, address string")
    assert [r.address for r in readers.cache_misses(want, want.limit(0), ["chain", "address"]).orderBy("address").collect()] == ["1", "2"]
    rows = spark.createDataFrame([("1", None), ("2", "old")], "k string, v string")
    got = readers.retry_upsert(rows, spark.createDataFrame([("1", "new"), ("2", "new")], "k string, v string"), ["k"], "v")
    assert sorted(map(tuple, got.collect())) == [("1", "new"), ("2", "old")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("eth", 1), ("bsc", 2)], "chain string, v int")
    sinks.write_by_chain(df, f"file://{tmp_path}/p")
    assert (tmp_path / "p" / "chain=eth").is_dir()
    sinks.append_jsonl(df, f"file://{tmp_path}/j")
    sinks.append_jsonl(df, f"file://{tmp_path}/j")
    assert spark.read.json(f"file://{tmp_path}/j").count() == 4
    m = sinks.manifest(spark, f"file://{tmp_path}/j")
    assert m.where(F.length("sha256") != 64).isEmpty() and sinks.verify_manifest(m, m).isEmpty()
    assert sinks.markdown(df.orderBy("v")).splitlines()[2] == "| eth | 1 |"
    assert [r.v for r in sinks.remaining(df, df.where("v = 1"), ["chain"]).collect()] == [2]
