"""The consumer queries, over the marts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.functions.keys import seconds_between


def ops_status(snapshot: DataFrame) -> DataFrame:
    """Shipments by current status."""
    return snapshot.groupBy(F.coalesce("current_status", F.lit("in_flight")).alias("status")).agg(F.count(F.lit(1)).alias("shipments")).orderBy(F.desc("shipments"), "status")


def ops_freshness(snapshot: DataFrame, as_of) -> DataFrame:
    """The newest event and its age."""
    newest = snapshot.agg(F.max("last_event_ts").alias("newest_event"))
    return newest.withColumn("age_seconds", seconds_between(F.col("newest_event"), F.lit(as_of).cast("timestamp_ntz")))


def fin_top_hubs(recon: DataFrame, k: int = 8) -> DataFrame:
    """The hub days with most events."""
    return recon.orderBy(F.desc("events"), "recon_date", "hub_code").limit(k).select("recon_date", "hub_code", "shipments", "events", "delivered", "exceptions")


def rel_versions(facts: DataFrame) -> DataFrame:
    """Rows by contract version and source."""
    return facts.groupBy("schema_version", "source").agg(F.count(F.lit(1)).alias("n")).orderBy("schema_version", F.desc("n"), "source")


def rel_alerts(alerts: DataFrame) -> DataFrame:
    """Alerts by severity and monitor."""
    return alerts.groupBy("severity", "monitor").agg(F.count(F.lit(1)).alias("n"), F.max("raised_at").alias("latest")).orderBy(F.desc("n"), "severity", "monitor")


def ds_cold_chain(telemetry: DataFrame) -> DataFrame:
    """Temperature range and readings above 8 degrees; rows without a temperature count as readings."""
    return telemetry.agg(F.round(F.min("temperature_c"), 1).alias("min_c"), F.round(F.max("temperature_c"), 1).alias("max_c"), F.count_if(F.col("temperature_c") > 8).alias("above_8c"), F.count(F.lit(1)).alias("readings"))


def version_mix(facts: DataFrame) -> DataFrame:
    return facts.groupBy("schema_version").agg(F.count(F.lit(1)).alias("n")).orderBy("schema_version")
