"""Bronze and quarantine files, by ingest day and hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.contracts import Registry
from waybill.functions.keys import payload_time
from waybill.schemas import BRONZE, QUARANTINE


def accepted_rows(registry: Registry, verdicts: DataFrame) -> DataFrame:
    """Bronze rows of the accepted records; ``verdicts`` needs ingest_ts, and may have shard_id and kinesis_seq."""
    rows = registry.canonical(verdicts)
    event_ts = payload_time(F.col("event_ts_text"))
    for name, kind in (("shard_id", "string"), ("kinesis_seq", "long")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    content = ["event_type", "event_ts_text", "shipment_id", "vehicle_id", "hub_code", "source", "status", "geo_lat", "geo_lon", "temperature_c", "window_start_text", "window_end_text", "metadata_json"]
    return rows.select(
        "event_id",
        "event_type",
        # An unreadable event time becomes the ingest time.
        F.coalesce(event_ts, F.col("ingest_ts").cast("timestamp")).alias("event_ts"),
        event_ts.isNull().alias("ts_fallback"),
        F.col("ingest_ts").cast("timestamp").alias("ingest_ts"),
        # The day is the one the payload's own offset says.
        F.coalesce(F.when(event_ts.isNotNull(), F.try_to_date(F.substring("event_ts_text", 1, 10))), F.to_date("ingest_ts")).alias("event_date"),
        "shipment_id",
        "vehicle_id",
        "hub_code",
        "source",
        "status",
        "geo_lat",
        "geo_lon",
        "temperature_c",
        payload_time(F.col("window_start_text")).alias("delivery_window_start"),
        payload_time(F.col("window_end_text")).alias("delivery_window_end"),
        "metadata_json",
        "schema_version",
        F.sha1(F.to_json(F.struct(*sorted(content)))).alias("payload_hash"),
        "shard_id",
        F.col("kinesis_seq").cast("long").alias("kinesis_seq"),
    )


def rejected_rows(registry: Registry, verdicts: DataFrame) -> DataFrame:
    get = lambda f: F.get_json_object("raw_payload", f"$.{f}")
    return verdicts.where("not ok").select(
        get("event_id").alias("event_id"),
        F.coalesce(get("source"), F.lit("unknown")).alias("source"),
        F.col("ingest_ts").cast("timestamp").alias("ingest_ts"),
        F.col("reason").alias("rejection_reason"),
        F.lit(",".join(registry.active)).alias("expected_schema_version"),
        "observed_fields",
        "raw_payload",
    )


def with_hour(rows: DataFrame) -> DataFrame:
    return rows.withColumn("dt", F.date_format("ingest_ts", "yyyy-MM-dd")).withColumn("hr", F.date_format("ingest_ts", "HH"))


def write_lake(rows: DataFrame, path: str) -> None:
    """Parquet (zstd, level 3) under dt=/hr= of the ingest time, in a batch's own folder.

    A batch that is delivered again replaces all of it, whatever hours it had before.
    """
    writer = with_hour(rows).write.partitionBy("dt", "hr").mode("overwrite").option("partitionOverwriteMode", "static")
    writer.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "3").parquet(path)


def read_bronze(spark: SparkSession, *paths: str) -> DataFrame:
    """Bronze rows of a folder, or of exactly the given files."""
    return spark.read.schema(BRONZE + ", dt string, hr string").parquet(*paths)


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUARANTINE + ", dt string, hr string").parquet(path)
