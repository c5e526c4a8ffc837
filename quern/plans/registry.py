"""Named queries over the driver tables, each with its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
#: Rows of which each becomes many: so many go to one task.
ROWS_A_TASK = 10_000


def query(name: str, sql: str | None = None):
    """Register the decorated function under ``name``."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str, each: int = ROWS_A_TASK) -> DataFrame:
    """``rows`` by the hash of a key over tasks of about ``each``, for work that unfolds a small file: few tasks read that."""
    return rows.repartition(max(1, -(-rows.count() // each)), key)


def queries() -> dict[str, Query]:
    import quern.plans.catalog  # noqa: F401

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    import quern.plans.catalog  # noqa: F401

    return dict(_ORACLES)
