"""Keyed upsert and insert-only loads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.functions.keys import surrogate

UPDATED = ("status", "geo_lat", "geo_lon", "temperature_c", "delivery_window_start", "delivery_window_end", "schema_version", "payload_hash", "updated_at")


def fact_rows(staged: DataFrame, as_of=None) -> DataFrame:
    """Staged rows as rows of the event fact."""
    version = F.col("schema_version") if "schema_version" in staged.columns else F.lit("v1")
    return staged.select(
        "event_id", "event_date", "event_ts", "ingest_ts",
        surrogate(F.col("shipment_id")).alias("shipment_key"), surrogate(F.col("vehicle_id")).alias("vehicle_key"), surrogate(F.col("hub_code")).alias("facility_key"),
        "event_type", "status", "geo_lat", "geo_lon", "temperature_c", "delivery_window_start", "delivery_window_end", "source",
        version.alias("schema_version"), "payload_hash", F.lit(as_of).cast("timestamp_ntz").alias("updated_at"),
    )


def upsert(target: DataFrame, source: DataFrame, key: Sequence[str], updated: Sequence[str], changed: Column | None = None) -> DataFrame:
    """``target`` after a merge, with ``_action``: insert, update, same (matched, not changed) or keep.

    ``source`` has one row a key.  ``changed`` is over ``t`` and ``s``.
    """
    t, s = target.alias("t"), source.alias("s")
    joined = t.join(s, [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) if k not in key[:1] else F.col(f"t.{k}") == F.col(f"s.{k}") for k in key], "full_outer")
    in_t, in_s = F.col(f"t.{key[0]}").isNotNull(), F.col(f"s.{key[0]}").isNotNull()
    changed = F.lit(True) if changed is None else changed
    action = F.when(~in_t, "insert").when(~in_s, "keep").when(changed, "update").otherwise("same")
    columns = [F.when(~in_t | (in_s & changed if c in updated else F.lit(False)), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in target.columns]
    return joined.select(*columns, action.alias("_action"))


def merge_facts(target: DataFrame, source: DataFrame) -> DataFrame:
    """Events by event_id; equal payload hashes leave the row alone.

    A correction that moves an event to another day replaces the row there:
    the join is on event_id alone, over the days that the caller read.
    """
    moved = F.col("t.event_date") != F.col("s.event_date")
    changed = ~F.col("t.payload_hash").eqNullSafe(F.col("s.payload_hash"))
    return upsert(target, source, ["event_id"], (*UPDATED, "event_date", "event_ts"), changed | moved)


def insert_new(target: DataFrame, offered: DataFrame, *key: str) -> DataFrame:
    """The offered rows (one a key) that the target lacks."""
    return offered.join(target.select(*key), list(key), "left_anti").select(*target.columns)
