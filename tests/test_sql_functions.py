"""The functions as SQL sees them."""

from quern.functions import bytecode, sql


def test_lateral_instructions_and_values(spark):
    sql.register(spark)
    rows = [(1, bytes.fromhex("6001600201635f00")), (2, b""), (3, None), (4, bytes.fromhex("7f0102"))]
    spark.createDataFrame(rows, "id int, code binary").createOrReplaceTempView("some_programs")
    got = [tuple(r) for r in spark.sql("SELECT id, i.* FROM some_programs, LATERAL instructions(code) i ORDER BY id, pos").collect()]
    assert got == [(i, k, *x) for i, c in rows for k, x in enumerate(bytecode.decode(c))] and {r[0] for r in got} == {1, 4}
    pushes = [tuple(r) for r in spark.sql("SELECT id, p.* FROM some_programs, LATERAL push_positions(code) p ORDER BY id, pos").collect()]
    assert pushes == [(1, 0, 1, 1, 2), (1, 1, 1, 3, 4), (1, 3, 4, 6, 8), (4, 0, 32, 1, 3)]
    totals = spark.sql("SELECT id, program_totals(code).n_ops AS n, size(disassemble(code).ops) AS m FROM some_programs ORDER BY id").collect()
    assert [(r.n, r.m) for r in totals] == [(4, 4), (0, 0), (0, 0), (1, 1)]
