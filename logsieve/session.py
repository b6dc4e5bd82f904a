"""Spark sessions with the settings that the operators rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Time arithmetic is in UTC; adaptive execution coalesces small and splits skewed shuffle partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
}


def session(master: str | None = None, shuffle_partitions: int | None = None, **settings: str) -> SparkSession:
    """A session; cluster deployments pass neither master nor partitions and keep the cluster's own."""
    b = SparkSession.builder.appName("logsieve").config(map=SETTINGS | settings)
    if master:
        b = b.master(master).config("spark.driver.memory", os.environ.get("LOGSIEVE_DRIVER_MEMORY", "8g")).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()
