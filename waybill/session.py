"""Spark sessions with the settings that results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    # Joins over unions of partitioned inputs can fail with it.
    "spark.sql.unionOutputPartitioning": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def session(app: str = "waybill", **conf: str) -> SparkSession:
    """A session; on a cluster the master and sizes come from spark-submit."""
    builder = SparkSession.builder.appName(app)
    for key, value in (SETTINGS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
