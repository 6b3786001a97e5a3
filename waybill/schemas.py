"""Table schemas and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ENVELOPE = "sequenceNumber long, partitionKey string, approximateArrivalTimestamp string, data string"

BRONZE = """event_id string, event_type string, event_ts timestamp, ingest_ts timestamp, event_date date, shipment_id string,
vehicle_id string, hub_code string, source string, status string, geo_lat double, geo_lon double, temperature_c double,
delivery_window_start timestamp, delivery_window_end timestamp, metadata_json string, schema_version string,
payload_hash string, shard_id string, kinesis_seq long, ts_fallback boolean"""

QUARANTINE = """event_id string, source string, ingest_ts timestamp, rejection_reason string,
expected_schema_version string, observed_fields string, raw_payload string"""

#: Stored tables: columns, key, partition column.
TABLES: dict[str, tuple[str, tuple[str, ...], str | None]] = {
    "late_arrivals": ("event_id string, shipment_id string, event_ts timestamp_ntz, ingest_ts timestamp_ntz, age_hours double, reason string", (), None),
    "hub_shipment": ("shipment_hk string, shipment_id string, load_dts timestamp_ntz, rec_src string", ("shipment_hk",), None),
    "hub_vehicle": ("vehicle_hk string, vehicle_id string, load_dts timestamp_ntz, rec_src string", ("vehicle_hk",), None),
    "hub_facility": ("facility_hk string, hub_code string, country string, load_dts timestamp_ntz, rec_src string", ("facility_hk",), None),
    "lnk_shipment_vehicle_facility": ("link_hk string, shipment_hk string, vehicle_hk string, facility_hk string, load_dts timestamp_ntz, rec_src string", ("link_hk",), None),
    "sat_shipment_status": (
        "shipment_hk string, event_ts timestamp_ntz, hash_diff string, load_dts timestamp_ntz, status string, geo_lat double, geo_lon double, delivery_window_start timestamp_ntz, delivery_window_end timestamp_ntz, schema_version string, rec_src string",
        ("shipment_hk", "event_ts", "hash_diff"),
        None,
    ),
    "sat_vehicle_telemetry": (
        "vehicle_hk string, event_ts timestamp_ntz, hash_diff string, load_dts timestamp_ntz, temperature_c double, geo_lat double, geo_lon double, rec_src string",
        ("vehicle_hk", "event_ts", "hash_diff"),
        None,
    ),
    "sat_event_metadata": ("event_id string, load_dts timestamp_ntz, payload string, rec_src string", ("event_id",), None),
    "load_watermark": ("feed string, watermark_ts timestamp_ntz, updated_at timestamp_ntz", ("feed",), None),
    "schema_change_log": ("changed_at timestamp_ntz, schema_version string, action string, actor string, note string", (), None),
    "alerts": ("raised_at timestamp_ntz, severity string, monitor string, message string, detail string", (), None),
    "pipeline_metrics": (
        "batch_id string, recorded_at timestamp_ntz, state string, records_in long, staged long, rows_merged long, rows_updated long, duplicates_suppressed long, late_arrivals long, quarantine_pct double, merge_ms double",
        ("batch_id",),
        None,
    ),
    "fact_shipment_events": (
        "event_id string, event_date date, event_ts timestamp_ntz, ingest_ts timestamp_ntz, shipment_key string, vehicle_key string, facility_key string, event_type string, status string, geo_lat double, geo_lon double, temperature_c double, delivery_window_start timestamp_ntz, delivery_window_end timestamp_ntz, source string, schema_version string, payload_hash string, updated_at timestamp_ntz",
        ("event_id",),
        "event_date",
    ),
    "fact_shipment_status_current": (
        "shipment_key string, shipment_id string, current_status string, first_event_ts timestamp_ntz, last_event_ts timestamp_ntz, pickup_ts timestamp_ntz, in_transit_ts timestamp_ntz, exception_ts timestamp_ntz, delivered_ts timestamp_ntz, last_vehicle_id string, last_hub_code string, last_geo_lat double, last_geo_lon double, delivery_window_start timestamp_ntz, delivery_window_end timestamp_ntz, event_count long, is_window_breached boolean, status_ts timestamp_ntz, vehicle_ts timestamp_ntz, hub_ts timestamp_ntz, lat_ts timestamp_ntz, lon_ts timestamp_ntz, start_ts timestamp_ntz, end_ts timestamp_ntz, updated_at timestamp_ntz",
        ("shipment_key",),
        None,
    ),
    "fact_daily_shipment_recon": (
        "recon_date date, hub_code string, shipments long, events long, delivered long, exceptions long, window_breaches long, restated_at timestamp_ntz, restatement_note string, updated_at timestamp_ntz",
        ("recon_date", "hub_code"),
        "recon_date",
    ),
    "dim_vehicle": ("vehicle_key string, vehicle_id string, first_seen timestamp_ntz, last_seen timestamp_ntz, source string", ("vehicle_key",), None),
    "dim_facility": ("facility_key string, hub_code string, country string, first_seen timestamp_ntz, last_seen timestamp_ntz", ("facility_key",), None),
    "dim_date": ("date_key date, year int, quarter int, month int, day int, day_name string, is_weekend boolean", ("date_key",), None),
}


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table][0])
