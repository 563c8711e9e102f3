"""Registry of named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..session import importable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with the DuckDB SQL of the same rows if SQL can express it."""

    def put(f: Query) -> Query:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")




def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def duck_values(rows: list[tuple], names: str) -> str:
    """The same inline rows as a DuckDB relation."""

    def lit(x) -> str:
        if isinstance(x, str):
            return "'" + x.replace("'", "''") + "'"
        if isinstance(x, list):
            return "[" + ", ".join(map(lit, x)) + "]::VARCHAR[]"
        if isinstance(x, float):
            return f"CAST({x!r} AS DOUBLE)"
        return "NULL" if x is None else str(x).lower()

    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS v({names}))"
