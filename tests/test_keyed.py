"""Appends by key that can be repeated."""

import pytest

from quern.schemas import struct
from quern.sources import readers, sinks

SCHEMA = struct("k long, j string, v string")


def add(spark, path, batch, rows):
    sinks.append_keyed(spark.createDataFrame(rows, SCHEMA).repartition(3), path, ["k", "j"], batch)


def held(spark, path):
    return sorted((tuple(r) for r in readers.read_keyed(spark, path, SCHEMA, ["k", "j"]).collect()), key=repr)


def test_each_key_once(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    first = [(1, "a", "x"), (1, "b", "x"), (2, None, "x"), (2, None, "w"), (None, "a", "x")]
    add(spark, path, "b1", first)
    add(spark, path, "b2", [(1, "a", "late"), (2, None, "late"), (None, "a", "late"), (3, "c", "y")])
    want = sorted([(1, "a", "x"), (1, "b", "x"), (2, None, "w"), (None, "a", "x"), (3, "c", "y")], key=repr)
    assert held(spark, path) == want
    add(spark, path, "b1", first)  # again, after b2
    add(spark, path, "b2", [(3, "c", "y")])
    assert held(spark, path) == want


def test_two_writers_that_do_not_see_each_other(spark, tmp_path):
    path, other = f"file://{tmp_path}/log", f"file://{tmp_path}/other"
    add(spark, path, "b1", [(1, "a", "x")])
    add(spark, other, "b2", [(1, "a", "y"), (2, "a", "y")])
    spark.read.schema(SCHEMA).json(f"{other}/batch=bb2").write.json(f"{path}/batch=bb2")
    assert held(spark, path) == [(1, "a", "x"), (2, "a", "y")]


def test_names_and_no_rows(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    with pytest.raises(ValueError, match="a batch is named"):
        add(spark, path, "../b", [(1, "a", "x")])
    add(spark, path, "b1", [])
    assert held(spark, path) == []
