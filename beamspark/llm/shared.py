"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from beamspark.plans.registry import Query

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query of this folder; ``sql`` is its DuckDB twin (none when SQL cannot say it)."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors see: spark.checkpoint.dir, or one below the warehouse where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/beamspark-steps"
    return base.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """The same rows as a Parquet table in the shared folder: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
