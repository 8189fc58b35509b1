"""The session the engine expects: ANSI arithmetic, UTC, adaptive execution."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Shuffle partitions are left to the cluster; adaptive execution coalesces and splits them.
CONF = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName("millrace")
    if master:
        builder = builder.master(master)
    for k, v in (CONF | more).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
