"""The local session used by the tests and the comparison script."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session() -> SparkSession:
    return (
        SparkSession.builder.master("local[8]").appName("airloom-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.log.level", "ERROR")
        .getOrCreate()
    )
