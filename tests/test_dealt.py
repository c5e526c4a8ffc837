"""Work that unfolds a small file is dealt over tasks, and what it gives is never broadcast."""

from pyspark.sql import functions as F

from quern.functions import cfg, features, opcodes
from quern.operators import audit
from quern.plans import programs


def test_parts_of_one_file_go_to_several_tasks(spark, tmp_path):
    part = spark.range(25_000).select(F.col("id").alias("p_partkey"), F.concat(F.lit("part "), "id").alias("p_name"))
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    code = programs.codes(spark, str(tmp_path))
    sizes = [r.n for r in code.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 3 and sum(sizes) == 25_000 and max(sizes) < 10_000


def test_sequences_are_not_broadcast(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"]), (3, None)], "id long, ops array<string>")
    out = audit.preserved(rows, rows.withColumn("ops", F.when(F.col("id") == 2, F.array(F.lit("d"))).otherwise(F.col("ops"))), "id", "ops")
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in out.collect()] == [(3, 1)]


def test_each_program_is_featurized_once(spark):
    rows = spark.createDataFrame([(1, "6001"), (1, "5b00"), (None, "00"), (2, "")], "id long, h string")
    out = features.featurize(rows, "id", "h", opcodes.vocabulary()).collect()
    assert sorted((r.id or 0) for r in out) == [0, 1, 1, 2]
    empty = next(r for r in out if r.id == 2)
    assert not any(empty.dense) and not any(empty.ngram)


def test_counts_of_the_control_flow_carry_no_texts(spark):
    rows = spark.createDataFrame([(1, bytearray(b"\x60\x03\x56\x5b\x00")), (2, None), (3, bytearray(b"\x00\x5b\x38\x01"))], "id long, c binary")
    both = rows.select(cfg.control_flow("c").alias("a"), cfg.control_flow_counts("c").alias("b"))
    assert set(both.schema["b"].dataType.names).isdisjoint({"compact", "masked", "stripped", "prefix", "suffix", "trailer"})
    assert all(r.a[n] == r.b[n] for r in both.collect() for n in cfg.COUNTS)
