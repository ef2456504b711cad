"""Query registry: a Spark callable and, where SQL can say it, an independent SQL text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel import ship
from chronopanel.schema import replace_columns, q

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, columns: Sequence[str], digits: int) -> DataFrame:
    """Compare floats at a fixed number of digits; adding 0.0 turns -0.0 into 0.0."""
    return replace_columns(df, {c: F.round(q(c), digits) + F.lit(0.0) for c in columns})


def rounded_sql(sql: str, columns: Sequence[str], digits: int) -> str:
    if not columns:
        return sql
    parts = ", ".join(f'round("{c}", {digits}) + 0.0 AS "{c}"' for c in columns)
    return f"SELECT * REPLACE ({parts}) FROM (\n{sql}\n) AS compared"


def query(name: str, sql: str | None = None, approx: Sequence[str] = (), digits: int = 6):
    """Register a query; ``approx`` lists float columns compared after rounding."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return rounded(fn(spark, sf_dir), list(approx), digits)

        run.__name__, run.__doc__ = name, fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = rounded_sql(sql.strip(), list(approx), digits)
        return fn

    return register
