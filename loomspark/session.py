"""A session with the settings the engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(name: str = "loomspark", cores: str = "8", partitions: int = 8) -> SparkSession:
    """local[cores] in UTC with adaptive execution; on a cluster use the cluster's own builder settings instead."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
