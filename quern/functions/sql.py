"""Functions for queries that are written in SQL alone."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from quern.functions import bytecode


@udtf(returnType="pos int, pc int, size int, code int, token string, immediate string", useArrow=True)
class Instructions:
    """``LATERAL instructions(code)``: the linear sweep of a byte string; none for null."""

    def eval(self, code: bytes) -> Iterator[tuple]:
        for pos, row in enumerate(bytecode.decode(code)):
            yield (pos, *row)


@udtf(returnType="pos int, width int, `start` int, `end` int", useArrow=True)
class PushPositions:
    """``LATERAL push_positions(code)``: where the immediates lie, a cut one as far as it goes."""

    def eval(self, code: bytes) -> Iterator[tuple]:
        for pos, (pc, size, byte, token, _) in enumerate(bytecode.decode(code)):
            if token == "PUSH":
                yield pos, byte - 0x5F, pc + 1, pc + size


def register(spark: SparkSession) -> None:
    """Make the functions known to the session: instructions and push_positions as tables, disassemble, program_totals and first_stop as values."""
    spark.udtf.register("instructions", Instructions)
    spark.udtf.register("push_positions", PushPositions)
    for name in ("disassemble", "program_totals", "first_stop"):
        spark.udf.register(name, getattr(bytecode, name))
