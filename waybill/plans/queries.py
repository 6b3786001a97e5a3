"""One query per operator over the shipment events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waybill import costs
from waybill.config import Config
from waybill.contracts import Registry
from waybill.functions.keys import hash_key, partition_key, shard_id, surrogate
from waybill.operators import audit, marts, merge, monitors, staging, vault
from waybill.plans import consumer
from waybill.schemas import empty
from waybill.sources import lake
from waybill.sources.adaptor import raw_payloads, shipment_events
from waybill.sources.generator import event_kinds
from waybill.sources.log import throughput, within_capacity

AS_OF = datetime(2024, 2, 1)
SPLIT = "2024-01-15"
LATEST_INGEST = "2024-01-25 00:00:00"


def _staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.deduplicated(staging.bounded(shipment_events(spark, sf_dir)))


def _versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged rows that a contract accepts, with its version."""
    verdicts = _registry().verdicts(raw_payloads(_staged(spark, sf_dir)))
    return verdicts.where("ok").select("schema_version", F.get_json_object("raw_payload", "$.source").alias("source"))


def _registry() -> Registry:
    registry = Registry()
    registry.activate("v2")
    registry.activate("v3")
    return registry


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct event's payload against all contracts."""
    events = staging.deduplicated(shipment_events(spark, sf_dir))
    return _registry().verdicts(raw_payloads(events))


def _event_id(verdicts: DataFrame):
    return F.get_json_object("raw_payload", "$.event_id").alias("event_id")


# --- scans and staging


def scan_bronze(spark, sf_dir):
    return shipment_events(spark, sf_dir).drop("metadata_json")


def bronze_rows(spark, sf_dir):
    rows = lake.accepted_rows(_registry(), _verdicts(spark, sf_dir))
    ntz = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("event_ts", "ingest_ts", "delivery_window_start", "delivery_window_end")]
    return rows.select("event_id", "event_type", "event_date", "shipment_id", "vehicle_id", "hub_code", "source", "status", "geo_lat", "geo_lon", "schema_version", "kinesis_seq", *ntz)


def bronze_layout(spark, sf_dir):
    rows = lake.with_hour(lake.accepted_rows(_registry(), _verdicts(spark, sf_dir)))
    return rows.groupBy("dt", "hr").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


def bronze_row_count(spark, sf_dir):
    return shipment_events(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))


def stage_bounded(spark, sf_dir):
    watermark = datetime(2024, 1, 10)
    return staging.bounded(shipment_events(spark, sf_dir), watermark=watermark).select("event_id", "event_ts", "ingest_ts", "payload_hash")


def stage_dedup(spark, sf_dir):
    return _staged(spark, sf_dir)


def late_arrivals(spark, sf_dir):
    return staging.beyond(shipment_events(spark, sf_dir))


def late_within_window(spark, sf_dir):
    return staging.late_within(_staged(spark, sf_dir)).select("event_id", "event_ts", "ingest_ts")


def batch_stats(spark, sf_dir):
    events = shipment_events(spark, sf_dir)
    return staging.stats(events, staging.deduplicated(staging.bounded(events)), staging.beyond(events))


# --- keys and shards


def surrogate_keys(spark, sf_dir):
    rows = _staged(spark, sf_dir)
    return rows.select("event_id", surrogate(F.col("shipment_id")).alias("shipment_key"), surrogate(F.col("vehicle_id")).alias("vehicle_key"), surrogate(F.col("hub_code")).alias("facility_key"), hash_key(F.col("shipment_id"), F.col("hub_code")).alias("trimmed_key"))


def partition_keys(spark, sf_dir):
    return shipment_events(spark, sf_dir).select("event_id", partition_key(F.col("vehicle_id"), F.col("hub_code"), F.col("shipment_id")).alias("partition_key"))


def shard_distribution(spark, sf_dir):
    key = partition_key(F.col("vehicle_id"), F.col("hub_code"), F.col("shipment_id"))
    return shipment_events(spark, sf_dir).groupBy(shard_id(key, 8).alias("shard_id")).agg(F.count(F.lit(1)).alias("n"))


def shard_distribution_md5(spark, sf_dir):
    key = partition_key(F.col("vehicle_id"), F.col("hub_code"), F.col("shipment_id"))
    return shipment_events(spark, sf_dir).groupBy(F.substring(F.md5(key), 1, 1).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


def throughput_windows(spark, sf_dir):
    return throughput(shipment_events(spark, sf_dir), "ingest_ts", shards=1, per_shard=1)


# --- contracts


def contract_verdicts(spark, sf_dir):
    v = _verdicts(spark, sf_dir)
    return v.select(_event_id(v), "ok", "schema_version", "reason")


def canonical_events(spark, sf_dir):
    v = _registry().canonical(_verdicts(spark, sf_dir))
    return v.select("event_id", "schema_version", "geo_lat", "geo_lon", F.to_timestamp("window_start_text").cast("timestamp_ntz").alias("delivery_window_start"), F.to_timestamp("window_end_text").cast("timestamp_ntz").alias("delivery_window_end"), "metadata_json")


def quarantine_rows(spark, sf_dir):
    rows = lake.rejected_rows(_registry(), _verdicts(spark, sf_dir))
    return rows.select("event_id", "source", F.col("ingest_ts").cast("timestamp_ntz").alias("ingest_ts"), "rejection_reason", "expected_schema_version", F.element_at(F.split("observed_fields", ","), -1).alias("last_field"))


def accepted_vs_rejected(spark, sf_dir):
    return _verdicts(spark, sf_dir).groupBy("ok", "schema_version").agg(F.count(F.lit(1)).alias("n"))


def violations_by_field(spark, sf_dir):
    registry = Registry()  # v1 alone: both renames are violations
    events = staging.deduplicated(shipment_events(spark, sf_dir))
    return monitors.violation_fields(registry.verdicts(raw_payloads(events)))


def null_counts(spark, sf_dir):
    rows = lake.accepted_rows(_registry(), _verdicts(spark, sf_dir))
    return rows.agg(F.count(F.lit(1)).alias("accepted"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in monitors.WATCHED])


def replay_candidates(spark, sf_dir):
    """What v1 rejects and all contracts accept."""
    events = staging.deduplicated(shipment_events(spark, sf_dir))
    rejected = lake.rejected_rows(Registry(), Registry().verdicts(raw_payloads(events)))
    again = _registry().verdicts(rejected.select("raw_payload", "ingest_ts"))
    return again.select(_event_id(again), F.col("ok").alias("recovered"), "schema_version")


def compat_check(spark, sf_dir):
    registry = _registry()
    rows = [(a, b, *registry.check_compatibility(a, b)) for a in registry.active for b in registry.active if a != b]
    return spark.createDataFrame([(a, b, ok, "; ".join(problems)) for a, b, ok, problems in rows], "old_version string, new_version string, compatible boolean, problems string")


# --- audit


def _soiled(staged: DataFrame) -> DataFrame:
    """Staged rows with every fault that the audit looks for."""
    n = F.col("kinesis_seq")
    out = staged.withColumns({
        "event_id": F.when(n % 401 != 0, F.col("event_id")),
        "shipment_id": F.when(n % 211 != 3, F.col("shipment_id")),
        "status": F.when(n % 173 == 5, F.lit("lost")).otherwise(F.col("status")),
        "geo_lat": F.when(n % 307 == 9, F.lit(90.5)).otherwise(F.col("geo_lat")),
        "geo_lon": F.when(n % 283 == 4, F.lit(-180.5)).otherwise(F.col("geo_lon")),
    })
    return out.unionByName(out.where("kinesis_seq % 503 = 11"))


def audit_checks(spark, sf_dir):
    c = audit.counts(_soiled(_staged(spark, sf_dir)))
    return c.select(F.explode(F.map_from_arrays(F.array(*[F.lit(x) for x in audit.CHECKS]), F.array(*[F.col(f"`{x}`").cast("long") for x in audit.CHECKS]))).alias("check_name", "n"))


def audit_null_rate(spark, sf_dir):
    return audit.null_pct(audit.counts(_staged(spark, sf_dir)))


def duplicate_check(spark, sf_dir):
    """Event ids that redelivery repeats, before staging."""
    return audit.duplicates(shipment_events(spark, sf_dir), "event_id")


def table_counts(spark, sf_dir):
    staged = _staged(spark, sf_dir)
    tables = {
        "fact_shipment_events": staged,
        "fact_shipment_status_current": marts.status_delta(staged),
        "hub_shipment": vault.hub_shipment(staged),
        "hub_vehicle": vault.hub_vehicle(staged),
        "hub_facility": vault.hub_facility(staged),
        "sat_shipment_status": vault.sat_status(staged),
        "late_arrivals": staging.beyond(shipment_events(spark, sf_dir)),
    }
    out = None
    for name, table in tables.items():
        one = table.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# --- merge and vault: two batches and corrections


def _batches(spark, sf_dir) -> list[DataFrame]:
    staged = _staged(spark, sf_dir)
    old = F.col("event_date") < SPLIT
    second = staged.where(~old | F.expr("kinesis_seq % 333 = 5"))
    second = second.withColumn("status", F.when(old, F.lit("delivered")).otherwise(F.col("status"))).withColumn("payload_hash", F.when(old, F.md5(F.concat("payload_hash", F.lit("c")))).otherwise(F.col("payload_hash")))
    return [staged.where(old), second]


def merge_events(spark, sf_dir):
    first, second = (merge.fact_rows(b, AS_OF) for b in _batches(spark, sf_dir))
    return merge.merge_facts(first, second).drop("updated_at").withColumnRenamed("_action", "merge_action")


def _vault(table: str):
    def run(spark, sf_dir):
        staged = _staged(spark, sf_dir)
        first = vault.load(table, None, staged.where(F.col("event_date") < SPLIT), AS_OF)
        more = vault.load(table, first, staged.where(F.col("event_date") >= SPLIT), AS_OF)
        return first.unionByName(more).drop("load_dts")

    return run


# --- marts


def ops_delta_status(spark, sf_dir):
    helpers = [when for _, when in marts.LAST.values()]
    return marts.status_delta(_staged(spark, sf_dir)).drop("is_window_breached", "first_event_ts", *helpers)


def _snapshot(spark, sf_dir) -> DataFrame:
    """The snapshot after two batches in the wrong order."""
    staged = _staged(spark, sf_dir)
    second = marts.merge_status(empty(spark, "fact_shipment_status_current"), marts.status_delta(staged.where("kinesis_seq % 3 = 0")))
    return marts.merge_status(second, marts.status_delta(staged.where("kinesis_seq % 3 <> 0")))


def ops_status_current(spark, sf_dir):
    return _snapshot(spark, sf_dir).drop("first_event_ts", *[when for _, when in marts.LAST.values()])


def recon_daily(spark, sf_dir):
    staged = _staged(spark, sf_dir)
    return marts.recon(merge.fact_rows(staged), marts.status_delta(staged))


def recon_restatement(spark, sf_dir):
    staged = _staged(spark, sf_dir)
    first = staged.where("kinesis_seq % 10 <> 0")
    empty_recon = empty(spark, "fact_daily_shipment_recon")
    old = marts.restate(empty_recon, marts.recon(merge.fact_rows(first), marts.status_delta(first)), AS_OF)
    new = marts.restate(old, marts.recon(merge.fact_rows(staged), marts.status_delta(staged)), AS_OF)
    return new.drop("updated_at")


def dim_date(spark, sf_dir):
    return marts.dim_date(spark)


def vehicle_assignments(spark, sf_dir):
    return marts.vehicle_assignments(merge.fact_rows(_staged(spark, sf_dir)))


def recon_incremental(spark, sf_dir):
    """The reconciliation after a second batch that redoes only the days it must; equal to that of one pass."""
    staged = _staged(spark, sf_dir)
    late = F.col("kinesis_seq") % 7 == 0
    first, second = staged.where(~late), staged.where(late & (F.col("event_date") >= SPLIT))
    before = marts.status_delta(first)
    after = marts.merge_status(before, marts.status_delta(second))
    days = second.select(F.col("event_date").alias("day")).union(marts.restated_days(before, after)).distinct()
    facts = merge.fact_rows(first.unionByName(second))
    redone = marts.recon(facts.join(days, F.col("event_date") == F.col("day"), "left_semi"), after)
    untouched = marts.recon(merge.fact_rows(first), before).join(days, F.col("recon_date") == F.col("day"), "left_anti")
    return redone.unionByName(untouched)


def dim_vehicle(spark, sf_dir):
    """The vehicles after two batches."""
    return _dimension(spark, sf_dir, "dim_vehicle", "vehicle_id", "vehicle_key")


def dim_facility(spark, sf_dir):
    return _dimension(spark, sf_dir, "dim_facility", "hub_code", "facility_key", F.split_part("hub_code", F.lit("-"), F.lit(2)).alias("country"))


def _dimension(spark, sf_dir, table, column, key, *extra):
    out = empty(spark, table)
    for batch in _batches(spark, sf_dir):
        out = marts.merge_dimension(out, batch, column, key, *extra)
    return out


def dim_date_seeded(spark, sf_dir):
    """Days that a dimension lacks which has the first half of the year."""
    return marts.dim_date(spark, existing=marts.dim_date(spark, last="2026-06-30"))


# --- monitors


def monitor_canary(spark, sf_dir):
    hours = _staged(spark, sf_dir).groupBy(F.date_trunc("hour", "ingest_ts").cast("timestamp_ntz").alias("hour")).agg((F.count("delivery_window_start") * 100.0 / F.count(F.lit(1))).cast("double").alias("share"))
    return monitors.canary(hours.withColumn("share", F.round("share", 6)), "hour", "share")


def monitor_violation(spark, sf_dir):
    events = staging.deduplicated(shipment_events(spark, sf_dir))
    v = Registry().verdicts(raw_payloads(events)).withColumn("source", F.get_json_object("raw_payload", "$.source")).withColumn("day", F.to_date("ingest_ts"))
    return monitors.violations(v, "day", "source")


def null_rate_recent(spark, sf_dir):
    return audit.recent_null_pct(_staged(spark, sf_dir), "delivery_window_start", LATEST_INGEST, 3600)


def _hours(spark, sf_dir) -> DataFrame:
    """Staged events as batches of an hour."""
    return _staged(spark, sf_dir).withColumn("hour", F.date_trunc("hour", "ingest_ts").cast("timestamp_ntz"))


def monitor_null_rate(spark, sf_dir):
    """The null rate of each watched column in each hour, and whether it alerts."""
    hours = _hours(spark, sf_dir).groupBy("hour").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in monitors.WATCHED])
    long = hours.unpivot(["hour", "n"], list(monitors.WATCHED), "column_name", "nulls")
    pct = F.col("nulls") * F.lit(100.0) / F.col("n")
    return long.select("hour", "column_name", F.round(pct, 6).alias("null_pct"), (pct > Config().null_alert_pct).alias("alerts"))


def monitor_freshness(spark, sf_dir):
    """Waits between ingested events of more than two minutes."""
    times = _staged(spark, sf_dir).select("ingest_ts").distinct()
    waits = times.withColumn("day", F.to_date("ingest_ts")).withColumn("last", F.lag("ingest_ts").over(Window.partitionBy("day").orderBy("ingest_ts")))
    waited = F.unix_micros(F.col("ingest_ts").cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))
    return waits.where(waited > 120_000_000).select("ingest_ts", waited.alias("waited_micros"))


def monitor_cooldown(spark, sf_dir):
    """Exceptions as firing monitors, a key a source: those that alert under a cooldown of an hour."""
    firing = _staged(spark, sf_dir).where("status = 'exception'").select(F.col("source").alias("key"), F.col("ingest_ts").alias("at")).distinct()
    return monitors.cooled(firing, 3600).select("key", F.col("at").alias("alerted_at"))


def load_watermark(spark, sf_dir):
    """The watermark after each hour's batch, taken in order of event id: it never goes back."""
    batches = _staged(spark, sf_dir).withColumn("batch", F.floor(F.col("kinesis_seq") / 100).cast("long")).groupBy("batch").agg(F.max("ingest_ts").alias("newest"))
    return batches.select("batch", F.max("newest").over(Window.orderBy("batch")).alias("watermark_ts"))


def throttled_records(spark, sf_dir):
    """Records beyond one a second, which a log of that capacity refuses."""
    rows = shipment_events(spark, sf_dir).select(F.col("ingest_ts").alias("arrival_ts"), (F.col("kinesis_seq") * 2 + F.when(F.col("ingest_ts") > F.col("event_ts") + F.expr("INTERVAL '70' SECOND"), 1).otherwise(0)).alias("seq"))
    return within_capacity(rows, 1).where("not admitted").select("arrival_ts", "seq")


def generated_events(spark, sf_dir):
    """Source, type and lateness of a thousand generated events."""
    return event_kinds(spark.range(1000), Config()).select(F.col("id").alias("seq"), "source", "event_type", F.col("late").cast("long").alias("late"))


def contract_errors(spark, sf_dir):
    """Payloads with wrong values, types, missing fields and broken JSON against the first contract."""
    events = staging.deduplicated(shipment_events(spark, sf_dir)).where("source in ('telematics_gateway', 'hub_scanner_net') and kinesis_seq % 500 <> 3")
    raw, kind = F.col("raw_payload"), F.col("kinesis_seq") % 8
    event_type = F.regexp_replace(raw, '"event_type":"[a-z_]+"', '"event_type":"lost"')
    soiled = F.when(kind == 1, event_type).when(kind == 2, F.regexp_replace(raw, '"event_id":"EV[0-9]+"', '"event_id":"EV1"'))
    soiled = soiled.when(kind == 3, F.regexp_replace(raw, '"shipment_id":"[^"]*",', "")).when(kind == 4, F.substring(raw, 1, 20)).when(kind == 5, F.regexp_replace(raw, '"source":"[a-z_]+"', '"source":7'))
    soiled = soiled.when(kind == 6, F.regexp_replace(event_type, '"event_id":"EV[0-9]+"', '"event_id":"EV1"')).when(kind == 7, F.regexp_replace(raw, '"event_ts":"[^"]*"', '"event_ts":"yesterday"')).otherwise(raw)
    return Registry().verdicts(raw_payloads(events).withColumn("raw_payload", soiled))


def contract_errors_found(spark, sf_dir):
    return contract_errors(spark, sf_dir).select("kinesis_seq", "ok", "reason", F.size("errors").alias("n_errors"))


def ts_fallback(spark, sf_dir):
    """Accepted rows whose time can't be read, which take that of their arrival."""
    rows = lake.accepted_rows(Registry(), contract_errors(spark, sf_dir)).where("ts_fallback")
    return rows.select("kinesis_seq", F.col("event_ts").cast("timestamp_ntz").alias("event_ts"), "event_date")


def top_violations(spark, sf_dir):
    """The three paths with most violations."""
    return monitors.violation_fields(contract_errors(spark, sf_dir)).orderBy(F.desc("n"), "field").limit(3)


def recent_alerts(spark, sf_dir):
    """The last six contract alerts."""
    v = monitor_violation(spark, sf_dir).where("severity is not null")
    alerts = v.select(F.col("day").alias("raised_at"), F.lit("contract_violation").alias("monitor"), F.col("source").alias("message"), "severity")
    return monitors.recent_alerts(alerts)


# --- reports


def q_ops_status(spark, sf_dir):
    return consumer.ops_status(marts.status_delta(_staged(spark, sf_dir)))


def q_ops_freshness(spark, sf_dir):
    return consumer.ops_freshness(marts.status_delta(_staged(spark, sf_dir)), AS_OF)


def q_fin_top_hubs(spark, sf_dir):
    return consumer.fin_top_hubs(recon_daily(spark, sf_dir))


def q_rel_versions(spark, sf_dir):
    return consumer.rel_versions(_versioned(spark, sf_dir))


def q_version_mix(spark, sf_dir):
    return consumer.version_mix(_versioned(spark, sf_dir))


def q_rel_alerts(spark, sf_dir):
    """Contract alerts of every source day."""
    v = monitor_violation(spark, sf_dir).where("severity is not null")
    return consumer.rel_alerts(v.select("severity", F.lit("contract_violation").alias("monitor"), F.col("day").alias("raised_at")))


def q_ds_cold_chain(spark, sf_dir):
    return consumer.ds_cold_chain(vault.sat_telemetry(_staged(spark, sf_dir)))


def q_cost_model(spark, sf_dir):
    """The cost model at the published ratios."""
    rows = []
    for ratio in (1.0, 5.0, 10.0, 43.0):
        s = costs.CostModel(ratio, 5.6).summary()
        rows.append((ratio, round(s["proposed"], 2), round(s["conservative"], 2)))
    return spark.createDataFrame(rows, "reprocess_ratio double, proposed double, conservative double")


def queries() -> dict:
    q = {
        f.__name__: f
        for f in (
            scan_bronze, bronze_rows, bronze_layout, bronze_row_count, stage_bounded, stage_dedup, late_arrivals, late_within_window, batch_stats,
            surrogate_keys, shard_distribution, shard_distribution_md5, throughput_windows, contract_verdicts, canonical_events, quarantine_rows,
            accepted_vs_rejected, violations_by_field, null_counts, replay_candidates, compat_check, audit_checks, audit_null_rate, duplicate_check, table_counts,
            merge_events, ops_delta_status, ops_status_current, recon_daily, recon_restatement, dim_date, vehicle_assignments, monitor_canary, monitor_violation,
            null_rate_recent, recon_incremental, dim_vehicle, dim_facility, dim_date_seeded, monitor_null_rate, monitor_freshness, monitor_cooldown, load_watermark,
            throttled_records, generated_events, contract_errors_found, ts_fallback, top_violations, recent_alerts, q_ops_status, q_ops_freshness, q_fin_top_hubs, q_rel_versions, q_version_mix, q_rel_alerts, q_ds_cold_chain, q_cost_model,
        )
    }
    q["partition_key"] = partition_keys
    names = {"vault_hub_shipment": "hub_shipment", "vault_hub_vehicle": "hub_vehicle", "vault_hub_facility": "hub_facility", "vault_link": "lnk_shipment_vehicle_facility", "vault_sat_status": "sat_shipment_status", "vault_sat_telemetry": "sat_vehicle_telemetry", "vault_sat_metadata": "sat_event_metadata"}
    return q | {name: _vault(table) for name, table in names.items()}
