"""Spark sessions and the tables of a data folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Session settings that fit the engine's semantics; sizes are left to adaptive execution.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.cteRecursionLevelLimit": "10000",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with the engine's settings; further ones by keyword with dots as double underscores."""
    builder = SparkSession.builder.appName("tesselon")
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views of the named tables, or of all."""
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
