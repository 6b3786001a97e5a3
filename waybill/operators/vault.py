"""Insert-only vault loads: hubs, link, satellites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waybill.functions.keys import fixed, hash_diff, surrogate
from waybill.operators.merge import insert_new

_VERSION = "schema_version"


def _hub(staged: DataFrame, column: str, key: str, as_of, *extra) -> DataFrame:
    # The source is any of the key's; the least one makes reruns agree.
    seen = staged.where(F.col(column).isNotNull()).groupBy(column).agg(F.min("source").alias("rec_src"))
    return seen.select(surrogate(F.col(column)).alias(key), column, *extra, F.lit(as_of).cast("timestamp_ntz").alias("load_dts"), "rec_src")


def _first(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def hub_shipment(staged: DataFrame, as_of=None) -> DataFrame:
    return _hub(staged, "shipment_id", "shipment_hk", as_of)


def hub_vehicle(staged: DataFrame, as_of=None) -> DataFrame:
    return _hub(staged, "vehicle_id", "vehicle_hk", as_of)


def hub_facility(staged: DataFrame, as_of=None) -> DataFrame:
    return _hub(staged, "hub_code", "facility_hk", as_of, F.split_part("hub_code", F.lit("-"), F.lit(2)).alias("country"))


def link(staged: DataFrame, as_of=None) -> DataFrame:
    seen = staged.groupBy("shipment_id", "vehicle_id", "hub_code").agg(F.min("source").alias("rec_src"))
    return seen.select(
        hash_diff(F.col("shipment_id"), F.col("vehicle_id"), F.col("hub_code")).alias("link_hk"),
        surrogate(F.col("shipment_id")).alias("shipment_hk"),
        surrogate(F.col("vehicle_id")).alias("vehicle_hk"),
        surrogate(F.col("hub_code")).alias("facility_hk"),
        F.lit(as_of).cast("timestamp_ntz").alias("load_dts"),
        "rec_src",
    )


def sat_status(staged: DataFrame, as_of=None) -> DataFrame:
    version = F.col(_VERSION) if _VERSION in staged.columns else F.lit("v1")
    rows = staged.where(F.col("event_type").isin("status", "hub_scan")).select(
        surrogate(F.col("shipment_id")).alias("shipment_hk"), "event_ts",
        hash_diff(F.col("status"), fixed(F.col("geo_lat")), fixed(F.col("geo_lon")), F.col("delivery_window_start")).alias("hash_diff"),
        F.lit(as_of).cast("timestamp_ntz").alias("load_dts"), "status", "geo_lat", "geo_lon", "delivery_window_start", "delivery_window_end", version.alias(_VERSION), F.col("source").alias("rec_src"), "event_id",
    )
    return _first(rows, ["shipment_hk", "event_ts", "hash_diff"], "event_id").drop("event_id")


def sat_telemetry(staged: DataFrame, as_of=None) -> DataFrame:
    rows = staged.where(F.col("vehicle_id").isNotNull() & F.col("event_type").isin("gps_ping", "temperature")).select(
        surrogate(F.col("vehicle_id")).alias("vehicle_hk"), "event_ts",
        hash_diff(fixed(F.col("temperature_c")), fixed(F.col("geo_lat")), fixed(F.col("geo_lon"))).alias("hash_diff"),
        F.lit(as_of).cast("timestamp_ntz").alias("load_dts"), "temperature_c", "geo_lat", "geo_lon", F.col("source").alias("rec_src"), "event_id",
    )
    return _first(rows, ["vehicle_hk", "event_ts", "hash_diff"], "event_id").drop("event_id")


def sat_metadata(staged: DataFrame, as_of=None) -> DataFrame:
    rows = staged.where(F.col("metadata_json").isNotNull())
    rows = _first(rows, ["event_id"], "ingest_ts", "kinesis_seq")
    return rows.select("event_id", F.lit(as_of).cast("timestamp_ntz").alias("load_dts"), F.col("metadata_json").alias("payload"), F.col("source").alias("rec_src"))


#: Table: what a batch offers, and the key under which it is new.
LOADS = {
    "hub_shipment": (hub_shipment, ("shipment_hk",)),
    "hub_vehicle": (hub_vehicle, ("vehicle_hk",)),
    "hub_facility": (hub_facility, ("facility_hk",)),
    "lnk_shipment_vehicle_facility": (link, ("link_hk",)),
    "sat_shipment_status": (sat_status, ("shipment_hk", "event_ts", "hash_diff")),
    "sat_vehicle_telemetry": (sat_telemetry, ("vehicle_hk", "event_ts", "hash_diff")),
    "sat_event_metadata": (sat_metadata, ("event_id",)),
}


def load(table: str, target: DataFrame | None, staged: DataFrame, as_of=None, since=None) -> DataFrame:
    """The rows that a batch adds to a vault table; none of its events is older than ``since``."""
    offer, key = LOADS[table]
    rows = offer(staged, as_of)
    if target is None:
        return rows
    if since is not None and "event_ts" in key:
        # An older row can't have the key of one in the batch, and files hold stretches of time.
        target = target.where(F.col("event_ts") >= F.lit(since))
    return insert_new(target, rows, *key)
