"""Session settings used by tests, benchmarks and the smoke query."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(name: str = "ragloom", cores: str | int = "*") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", os.environ.get("RAGLOOM_PARTITIONS", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("RAGLOOM_DRIVER_MEMORY", "6g"))
        .getOrCreate()
    )
