"""Shipment events shaped from the generic ``events`` table.

One SQL text serves both engines; ``{events}`` is the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHIPMENT_EVENTS = """
WITH base AS (
  SELECT event_id AS n, ts, user_id, event_type AS et, value, props,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k
  FROM {events}
), shaped AS (
  SELECT concat('EV', lpad(CAST(n AS STRING), 10, '0')) AS event_id,
         CASE et WHEN 'click' THEN 'gps_ping' WHEN 'view' THEN 'temperature'
                 WHEN 'signup' THEN 'hub_scan' ELSE 'status' END AS event_type,
         ts AS event_ts,
         CASE WHEN n % 100 = 0 THEN ts + INTERVAL '30' HOUR
              WHEN n % 100 < 6 THEN ts + INTERVAL '3' HOUR
              ELSE ts + INTERVAL '20' SECOND END AS ingest_ts,
         CAST(ts AS DATE) AS event_date,
         concat('SHP-', lpad(CAST(user_id AS STRING), 6, '0')) AS shipment_id,
         CASE WHEN et = 'signup' THEN NULL
              ELSE concat('VEH-', lpad(CAST(n % 97 AS STRING), 6, '0')) END AS vehicle_id,
         concat('HUB-', substr('GBFRDEUS', CAST(user_id % 4 AS INT) * 2 + 1, 2), '-',
                lpad(CAST(user_id % 12 AS STRING), 3, '0')) AS hub_code,
         CASE WHEN n % 100 < 48 THEN 'telematics_gateway' WHEN n % 100 < 70 THEN 'hub_scanner_net'
              WHEN n % 100 < 88 THEN 'partner_courier_api' ELSE 'driver_mobile_app' END AS source,
         CASE WHEN et = 'error' THEN 'exception'
              WHEN et = 'purchase' AND k < 33 THEN 'pickup'
              WHEN et = 'purchase' AND k < 66 THEN 'in_transit'
              WHEN et = 'purchase' THEN 'delivered' END AS status,
         CASE WHEN n % 50 = 7 THEN NULL
              ELSE CAST(n * 7919 % 18000000 - 9000000 AS DOUBLE) / 1e5 END AS geo_lat,
         CASE WHEN n % 50 = 7 THEN NULL
              ELSE CAST(n * 6271 % 36000000 - 18000000 AS DOUBLE) / 1e5 END AS geo_lon,
         CASE WHEN et = 'view' THEN value / 1e1 - 2e1 END AS temperature_c,
         CASE WHEN n % 11 = 0 THEN NULL ELSE ts + INTERVAL '2' HOUR END AS delivery_window_start,
         CASE WHEN n % 11 = 0 THEN NULL ELSE ts + INTERVAL '6' HOUR END AS delivery_window_end,
         CASE WHEN k % 4 = 0 THEN NULL ELSE props END AS metadata_json,
         md5(concat_ws('|', et, CAST(k AS STRING), CAST(user_id AS STRING))) AS payload_hash,
         n AS kinesis_seq
  FROM base
)
SELECT * FROM shaped
UNION ALL
SELECT event_id, event_type, event_ts, ingest_ts + INTERVAL '60' SECOND, event_date, shipment_id, vehicle_id,
       hub_code, source, status, geo_lat, geo_lon, temperature_c, delivery_window_start, delivery_window_end,
       metadata_json, payload_hash, kinesis_seq
FROM shaped WHERE kinesis_seq % 250 = 1
"""

#: From these days on a source writes another contract's shape.
V2_FROM, V3_FROM = "2024-01-10", "2024-01-20"


def shipment_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SHIPMENT_EVENTS, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def raw_payloads(events: DataFrame) -> DataFrame:
    """The JSON records a producer would send for ``events``, with two drifting sources and stray fields."""
    v2 = (F.col("source") == "partner_courier_api") & (F.col("event_date") >= F.lit(V2_FROM).cast("date"))
    v3 = (F.col("source") == "driver_mobile_app") & (F.col("event_date") >= F.lit(V3_FROM).cast("date"))
    iso = lambda c: F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    start, end = iso("delivery_window_start"), iso("delivery_window_end")
    has_window, has_geo = F.col("delivery_window_start").isNotNull(), F.col("geo_lat").isNotNull()
    payload = F.to_json(
        F.struct(
            "event_id",
            "event_type",
            iso("event_ts").alias("event_ts"),
            "shipment_id",
            "vehicle_id",
            "hub_code",
            "source",
            "status",
            "temperature_c",
            F.when(has_geo & ~v3, F.struct(F.col("geo_lat").alias("lat"), F.col("geo_lon").alias("lon"))).alias("geo"),
            F.when(has_geo & v3, F.struct(F.col("geo_lat").alias("latitude"), F.col("geo_lon").alias("longitude"))).alias("position"),
            F.when(has_window & ~v2, F.struct(start.alias("start"), end.alias("end"))).alias("delivery_window"),
            F.when(has_window & v2, F.struct(start.alias("window_start"), end.alias("window_end"))).alias("delivery"),
            F.from_json("metadata_json", "map<string,int>").alias("metadata"),
            F.when(F.col("kinesis_seq") % 500 == 3, F.lit("boom")).alias("surprise_column"),
        )
    )
    return events.select(payload.alias("raw_payload"), "ingest_ts", "kinesis_seq")
