"""Registry of queries over the standard tables and the SQL each one must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def registered(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` is its DuckDB twin (none when SQL cannot say it)."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rnd(col: Column | str, digits: int = 6) -> Column:
    """Round for comparison; adding 0.0 turns a negative zero into zero."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col, digits) + F.lit(0.0)


def rnd_fast(col: Column | str, digits: int = 6) -> Column:
    """The values of ``rnd`` for very many rows: it makes a decimal number of every value, this only of large ones and near halves."""
    col = F.col(col) if isinstance(col, str) else col
    scaled = col * F.lit(10.0**digits)
    near = F.rint(scaled)
    plain = (F.abs(scaled) < 1e9) & (F.abs(scaled - near) < 0.499999)
    return F.when(plain, near / F.lit(10.0**digits)).otherwise(F.round(col, digits)) + F.lit(0.0)


def big(col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return col.cast("bigint")


def micros(col: str) -> Column:
    """Microseconds since the epoch of a time column with or without zone."""
    return F.unix_micros(F.col(col).cast("timestamp"))
