"""Tables as parquet files of a folder."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def named(text: str) -> list[str]:
    """The tables whose names stand in a text."""
    return [name for name in NAMES if re.search(rf"\b{name}\b", text)]
