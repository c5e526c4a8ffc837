"""Fixed schemas; a reader fails on a missing column instead of inferring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def kind(name: str) -> T.DataType:
    """A type by name; ``[x]`` is an array. Unlike a DDL string it needs no session."""
    return T.ArrayType(kind(name[1:-1])) if name.startswith("[") else _TYPES[name]


def struct(fields: str) -> T.StructType:
    """``"a string, b [int]"`` as a struct type."""
    return T.StructType([T.StructField(n, kind(t)) for n, t in (f.split() for f in fields.split(","))])


CONTRACTS = struct("address string, chain string, class string, bytecode string")
FAMILIES = struct("address string, chain string, class string, family_id string, family_id_075 string, family_id_085 string, family_id_090 string")
GETCODE = struct("address string, class string, code_bytes int, is_7702_designator int, delegate_target string")
INSTRUCTIONS = struct("Contract int, Opcode string, Operand string, Gas int, Label int")
PREDICTIONS = struct("sid string, family_id string, fold int, y int, model string, seed int, score double, threshold double, pred int, split string")
RULE_HITS = struct("address string, path string, result [[string]]")
RELATIONS = struct("target_address string, deployer string, related_contracts [string]")


def require(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` itself, or an error naming the columns it lacks."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
