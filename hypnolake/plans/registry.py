"""Query registry: a Spark callable and, where SQL can say the same, its oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
UNROUNDED: dict[str, str] = {}  # oracle text before rounding, for composed reports


def query(name: str, sql: str | None = None, dbl: str = "", nd: int = 9):
    """Register ``fn(spark, sf_dir)``. ``dbl`` lists floating columns, rounded alike on both sides."""
    doubles = dbl.split()

    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.withColumns({c: F.round(F.col(c).cast("double"), nd) + F.lit(0.0) for c in doubles})

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            UNROUNDED[name] = sql
            fixed = ", ".join(f"round(CAST({c} AS DOUBLE), {nd}) + 0.0 AS {c}" for c in doubles)
            ORACLES[name] = f"SELECT * REPLACE ({fixed}) FROM (\n{sql}\n)" if doubles else sql
        return fn

    return deco
