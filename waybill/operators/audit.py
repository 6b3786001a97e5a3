"""The write-audit-publish gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.contracts.versions import STATUSES

#: Check names in the order they are reported.
CHECKS = ("event_id not null", "shipment_id not null", "event_id unique", "status in accepted set", "geo within bounds")


def counts(staged: DataFrame) -> DataFrame:
    """All checks' counts in one pass, and the share of null window starts."""
    geo = ~F.col("geo_lat").between(-90, 90) | ~F.col("geo_lon").between(-180, 180)
    per_event = staged.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("shipment_id").isNull()).alias("no_shipment"),
        F.count_if(~F.col("status").isin(*STATUSES)).alias("bad_status"),
        F.count_if(geo).alias("bad_geo"),
        F.count_if(F.col("delivery_window_start").isNull()).alias("no_window"),
    )
    return per_event.agg(
        F.coalesce(F.sum(F.when(F.col("event_id").isNull(), F.col("n"))), F.lit(0)).alias("event_id not null"),
        F.coalesce(F.sum("no_shipment"), F.lit(0)).alias("shipment_id not null"),
        F.count_if(F.col("event_id").isNotNull() & (F.col("n") > 1)).alias("event_id unique"),
        F.coalesce(F.sum("bad_status"), F.lit(0)).alias("status in accepted set"),
        F.coalesce(F.sum("bad_geo"), F.lit(0)).alias("geo within bounds"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("no_window"), F.lit(0)).alias("null_windows"),
    )


def null_pct(counted: DataFrame) -> DataFrame:
    pct = F.lit(100.0) * F.col("null_windows").cast("double") / F.nullif(F.col("rows"), F.lit(0)).cast("double")
    return counted.select("rows", "null_windows", F.round(pct, 6).alias("null_pct"))


def recent_null_pct(facts: DataFrame, column: str, as_of, seconds: int) -> DataFrame:
    """Rows ingested in the ``seconds`` up to ``as_of`` (None: now), and the percentage of them in which ``column`` is null."""
    now = F.current_timestamp().cast("timestamp_ntz") if as_of is None else F.lit(as_of).cast("timestamp_ntz")
    recent = facts.where((F.col("ingest_ts") > now - F.make_dt_interval(secs=F.lit(seconds))) & (F.col("ingest_ts") <= now))
    pct = F.count_if(F.col(column).isNull()) * F.lit(100.0) / F.nullif(F.count(F.lit(1)), F.lit(0))
    return recent.agg(F.count(F.lit(1)).alias("n"), F.round(pct.cast("double"), 6).alias("null_pct"))


def failures(staged: DataFrame, null_alert_pct: float = 15.0) -> list[str]:
    """What blocks the batch; empty if it may be published."""
    row = counts(staged).first().asDict()
    found = [name for name in CHECKS if row[name] > 0]
    if row["rows"] and (pct := 100.0 * row["null_windows"] / row["rows"]) > null_alert_pct:
        found.append(f"delivery_window_start null rate {pct:.1f}%")
    return found


def duplicates(table: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once."""
    return table.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
