"""Staging: bounds, late split, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill.functions.keys import minutes_between

LATE_REASON = "beyond 24h watermark - requires partition restatement"


def _cutoff(as_of, hours: int) -> Column:
    """The oldest event time taken: against ``as_of``, or against each row's own ingest time."""
    clock = F.col("ingest_ts") if as_of is None else F.lit(as_of)
    return clock - F.expr(f"INTERVAL '{hours}' HOUR")


def bounded(events: DataFrame, watermark=None, as_of=None, hours: int = 24) -> DataFrame:
    """Rows after the watermark and not older than the lateness bound."""
    rows = events if watermark is None else events.where(F.col("ingest_ts") > F.lit(watermark))
    return rows.where(F.col("event_ts") >= _cutoff(as_of, hours))


def beyond(events: DataFrame, watermark=None, as_of=None, hours: int = 24) -> DataFrame:
    """The late side table's rows; not deduplicated."""
    rows = events if watermark is None else events.where(F.col("ingest_ts") > F.lit(watermark))
    late = rows.where(F.col("event_ts") < _cutoff(as_of, hours))
    age = minutes_between(F.col("event_ts"), F.col("ingest_ts")).cast("double") / 60.0
    return late.select("event_id", "shipment_id", "event_ts", "ingest_ts", age.alias("age_hours"), F.lit(LATE_REASON).alias("reason"))


def deduplicated(events: DataFrame) -> DataFrame:
    """One row an event_id: the last ingested, then the least payload hash and sequence number."""
    order = Window.partitionBy("event_id").orderBy(F.desc("ingest_ts"), "payload_hash", "kinesis_seq")
    return events.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def late_within(staged: DataFrame, minutes: int = 5) -> DataFrame:
    return staged.where(F.col("event_ts") < F.col("ingest_ts") - F.expr(f"INTERVAL '{minutes}' MINUTE"))


def stats(events: DataFrame, staged: DataFrame, late: DataFrame) -> DataFrame:
    """Counts of a batch in one row."""
    counted = events.select(F.lit(1).alias("raw"), F.lit(0).alias("st"), F.lit(0).alias("bd"), F.lit(0).alias("lt"))
    inside = F.when(F.col("event_ts") < F.col("ingest_ts") - F.expr("INTERVAL '5' MINUTE"), 1).otherwise(0)
    counted = counted.union(staged.select(F.lit(0), F.lit(1), F.lit(0), inside)).union(late.select(F.lit(0), F.lit(0), F.lit(1), F.lit(0)))
    one = counted.agg(F.sum("raw").alias("records_in"), F.sum("st").alias("staged"), F.sum("bd").alias("beyond_watermark"), F.sum("lt").alias("late_arrivals"))
    return one.select("records_in", "staged", "beyond_watermark", "late_arrivals", F.greatest(F.col("records_in") - F.col("staged") - F.col("beyond_watermark"), F.lit(0)).alias("duplicates_suppressed"))
