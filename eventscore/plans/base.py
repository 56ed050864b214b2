"""The registry of queries, and the tables they read. Oracle SQL may use {ev}: events with seconds since 2024-01-01."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

EPOCH = 1704067200
EV = f"ev as (select event_id, user_id, event_type, value, props, epoch_us(ts) as us, (epoch_us(ts) - {EPOCH}000000) / 1e6 as t from events)"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.replace("{ev}", EV)
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props", us.alias("us"), ((us - EPOCH * 1000000) / 1e6).alias("t"))


def r4(c, name: str):
    return F.round(c, 4).alias(name)


def product4(c, name: str):
    """Four places as DuckDB rounds a double: the product with 10000, half away from zero. Spark's round goes by the
    shortest decimal, which differs where the product falls short of a half."""
    return (F.round(c * 10000.0) / 10000.0).alias(name)
