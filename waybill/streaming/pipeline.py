"""One batch from raw records to published marts, and the stream that drives it."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.config import Config
from waybill.contracts import Registry
from waybill.operators import audit, marts, merge, staging, vault
from waybill.operators.monitors import Alert, BatchResult, MonitorSuite, batch_result
from waybill.sources import lake
from waybill.sources.log import stream_log
from waybill.schemas import BRONZE
from waybill.store import Store

IDLE, NO_NEW_ROWS, PUBLISHED = "IDLE", "NO_NEW_ROWS", "PUBLISHED"
BLOCKED_BREAKER, BLOCKED_AUDIT, ROLLED_BACK = "BLOCKED_CIRCUIT_BREAKER", "BLOCKED_AUDIT", "ROLLED_BACK"


@dataclass
class MergeStats:
    """What became of a batch."""

    batch_id: str
    state: str
    records_in: int = 0
    staged: int = 0
    inserted: int = 0
    updated: int = 0
    unchanged: int = 0
    duplicates_suppressed: int = 0
    late_arrivals: int = 0
    beyond_watermark: int = 0
    failures: tuple[str, ...] = ()

    @property
    def rows_merged(self) -> int:
        return self.inserted


def is_done(state: dict, batch_id: str) -> bool:
    """Whether a batch was taken: published, held back or queued.

    Of a stream's batches, which come in order, only the last number is kept.
    """
    number = re.fullmatch(r"stream-(\d+)", batch_id)
    if number and int(number[1]) <= state.get("stream", -1):
        return True
    return batch_id in state["batches"] or batch_id in state["blocked"] or any(q["batch"] == batch_id for q in state.get("queue", []))


def mark_done(state: dict, batch_id: str) -> None:
    number = re.fullmatch(r"stream-(\d+)", batch_id)
    if number:
        state["stream"] = max(state.get("stream", -1), int(number[1]))
    else:
        state["batches"].append(batch_id)


class Pipeline:
    """Contracts, lake, store and monitors of one feed.

    Whatever must outlive the driver is in the store's manifest, and changes with
    the tables in one commit: batches taken, folders, the queue, the monitors'
    state, the time of the last publication.
    """

    def __init__(self, spark: SparkSession, root: str, config: Config | None = None, registry: Registry | None = None):
        self.spark, self.root, self.config = spark, root.rstrip("/"), config or Config()
        self.store = Store(spark, f"{self.root}/tables")
        state = self.store.manifest()["state"]
        self.registry = registry or Registry(active=list(state["active"]))
        self.monitors = MonitorSuite(self.config, state.get("monitors"))

    def bootstrap(self, at: datetime | None = None, days: tuple[str, str] = ("2026-01-01", "2026-12-31")) -> int:
        """Load the days that dim_date lacks and set the first watermark; how many days were new."""
        at = at or datetime.now(timezone.utc)
        manifest = self.store.manifest()
        fresh = marts.dim_date(self.spark, *days, existing=self.store.read("dim_date", manifest)).persist()
        n = fresh.count()
        if n:
            self.store.append(manifest, "dim_date", self.store.write("dim_date", fresh))
        if not manifest["tables"].get("load_watermark"):
            self._set_watermark(manifest, datetime(1970, 1, 1), at)
        if n or not manifest["version"]:
            self.store.commit(manifest)
        fresh.unpersist()
        return n

    def deliver(self, records: DataFrame, batch_id: str, at: datetime) -> tuple[BatchResult, str, str]:
        """Validate raw records (raw_payload) and land them; the batch's figures and folders.

        A batch that is delivered again takes the place of its first delivery.
        """
        rows = records.withColumn("ingest_ts", F.lit(at).cast("timestamp"))
        verdicts = self.registry.verdicts(rows).persist()
        bronze, quarantine = f"{self.root}/bronze/batch={batch_id}", f"{self.root}/quarantine/batch={batch_id}"
        try:
            accepted = lake.accepted_rows(self.registry, verdicts)
            lake.write_lake(accepted, bronze)
            lake.write_lake(lake.rejected_rows(self.registry, verdicts), quarantine)
            return batch_result(verdicts, accepted), bronze, quarantine
        finally:
            verdicts.unpersist()

    def _rows(self, folders: list[str]) -> DataFrame:
        out = self.spark.createDataFrame([], BRONZE)
        for folder in folders:
            out = out.unionByName(lake.read_bronze(self.spark, folder).drop("dt", "hr"))
        return out

    def _received(self, batch_id: str, records: DataFrame, at: datetime) -> tuple[BatchResult, str, dict, list[Alert]]:
        """Deliver a batch and judge it; its figures, its bronze folder, what it changes in the state, and alerts."""
        batch, bronze, quarantine = self.deliver(records, batch_id, at)
        state = self.store.manifest()["state"]
        since = state.get("published_at") or state.get("started_at")
        note = {"started_at": state.get("started_at") or at.isoformat()}
        self.monitors.state = state.get("monitors", {"fired": {}, "shares": []})
        alerts = self.monitors.evaluate(batch, (at - datetime.fromisoformat(since)).total_seconds() if since else 0.0, at)
        note["monitors"] = self.monitors.state
        if batch.quarantined:
            note["quarantine"] = [*[q for q in state["quarantine"] if q != quarantine], quarantine]
        return batch, bronze, note, alerts

    def merge(self, bronze: DataFrame, batch_id: str, at: datetime, quarantine_pct: float = 0.0, note: dict | None = None, alerts: list[Alert] | None = None, parts: list[str] | None = None) -> MergeStats:
        """Stage, audit and publish landed rows; ``note`` and ``alerts`` go into the same commit.

        A batch id that was taken before changes nothing.  ``parts`` are the ids of
        delivered batches that are merged as one.  If publishing fails, that is
        recorded, nothing of the batch is published, and the error goes on.
        """
        manifest, c = self.store.manifest(), self.config
        state = manifest["state"]
        began = time.monotonic()
        if is_done(state, batch_id):
            return MergeStats(batch_id, IDLE)
        state.update(note or {})
        parts, at_ntz = parts or [batch_id], at.replace(tzinfo=None)

        def record(stats: MergeStats) -> MergeStats:
            return self._record(manifest, stats, at_ntz, quarantine_pct, began, alerts or [])

        if quarantine_pct > c.breaker_pct:
            state["blocked"] += parts
            return record(MergeStats(batch_id, BLOCKED_BREAKER))
        ntz = [F.col(x).cast("timestamp_ntz").alias(x) if t == "timestamp" else F.col(x) for x, t in bronze.dtypes]
        events = bronze.select(*ntz)
        staged = staging.deduplicated(staging.bounded(events, as_of=at_ntz, hours=c.lateness_hours)).persist()
        late = staging.beyond(events, as_of=at_ntz, hours=c.lateness_hours)
        try:
            counted = staging.stats(events, staged, late).first()
            stats = MergeStats(batch_id, NO_NEW_ROWS, counted.records_in, counted.staged, late_arrivals=counted.late_arrivals, beyond_watermark=counted.beyond_watermark, duplicates_suppressed=counted.duplicates_suppressed)
            if counted.beyond_watermark:
                self.store.append(manifest, "late_arrivals", self.store.write("late_arrivals", late))
            if not counted.staged:
                for part in parts:
                    mark_done(state, part)
                return record(stats)
            stats.failures = tuple(audit.failures(staged, c.null_alert_pct))
            if stats.failures:
                # Of the batch only its late and quarantined rows and the block are known.
                state["blocked"] += parts
                stats.state = BLOCKED_AUDIT
                return record(stats)
            try:
                self._publish(manifest, staged, at_ntz, stats)
            except Exception:
                manifest = self.store.manifest()
                stats.state, alerts = ROLLED_BACK, []
                record(stats)
                raise
            for part in parts:
                mark_done(state, part)
            state["blocked"] = [b for b in state["blocked"] if b not in parts]
            state["published_at"] = at.isoformat()
            stats.state = PUBLISHED
            return record(stats)
        finally:
            staged.unpersist()

    def _publish(self, manifest: dict, staged: DataFrame, at: datetime, stats: MergeStats) -> None:
        """Write every table's new folders; the caller commits them together."""
        store = self.store
        known = manifest["tables"].get("fact_shipment_events", {})
        # Days in the batch, and days where one of its events stands already.
        days = {str(r[0]) for r in staged.select("event_date").distinct().collect()}
        facts = merge.fact_rows(staged, at)
        elsewhere = store.read("fact_shipment_events", manifest, [d for d in known if d not in days]).select("event_id", F.col("event_date").alias("_day"))
        days |= {str(r[0]) for r in elsewhere.join(facts.select("event_id"), "event_id", "left_semi").select("_day").distinct().collect()}
        merged = merge.merge_facts(store.read("fact_shipment_events", manifest, sorted(days)), facts).persist()
        bounds = staged.agg(F.max("ingest_ts").alias("newest"), F.min("event_ts").alias("oldest")).first()
        before = store.read("fact_shipment_status_current", manifest)
        try:
            actions = {r["_action"]: r["count"] for r in merged.groupBy("_action").count().collect()}
            stats.inserted, stats.updated, stats.unchanged = (actions.get(k, 0) for k in ("insert", "update", "same"))
            new = merged.where("_action = 'insert'").select("event_id")
            for day in days:
                manifest["tables"].get("fact_shipment_events", {}).pop(day, None)
            store.replace(manifest, "fact_shipment_events", store.write("fact_shipment_events", merged.drop("_action")))
            for table in vault.LOADS:
                store.append(manifest, table, store.write(table, vault.load(table, store.read(table, manifest), staged, at, bounds.oldest)))
            # A redelivered event changes no count: only rows new to the fact are added.
            delta = marts.status_delta(staged)
            fresh = staged.join(new, "event_id", "left_semi").groupBy("shipment_id").agg(F.count(F.lit(1)).alias("_new"))
            delta = delta.join(fresh, "shipment_id", "left").withColumn("event_count", F.coalesce("_new", F.lit(0).cast("long"))).drop("_new")
            snapshot = marts.merge_status(before, delta).withColumn("updated_at", F.lit(at).cast("timestamp_ntz"))
            store.replace(manifest, "fact_shipment_status_current", store.write("fact_shipment_status_current", snapshot))
        finally:
            merged.unpersist()
        # Earlier days too, where a shipment counts under another hub or as a breach now.
        after = store.read("fact_shipment_status_current", manifest)
        days |= {str(r[0]) for r in marts.restated_days(before, after).collect()} & manifest["tables"]["fact_shipment_events"].keys()
        touched = sorted(days)
        old = store.read("fact_daily_shipment_recon", manifest, touched)
        daily = marts.recon(store.read("fact_shipment_events", manifest, touched), after)
        folders = store.write("fact_daily_shipment_recon", marts.restate(old, daily, at))
        for day in days:
            manifest["tables"].get("fact_daily_shipment_recon", {}).pop(day, None)
        store.replace(manifest, "fact_daily_shipment_recon", folders)
        country = F.split_part("hub_code", F.lit("-"), F.lit(2)).alias("country")
        for table, column, key, extra in (("dim_vehicle", "vehicle_id", "vehicle_key", ()), ("dim_facility", "hub_code", "facility_key", (country,))):
            store.replace(manifest, table, store.write(table, marts.merge_dimension(store.read(table, manifest), staged, column, key, *extra)))
        self._set_watermark(manifest, bounds.newest, at)
        for table in (*vault.LOADS, "late_arrivals", "pipeline_metrics", "alerts"):
            store.compact(manifest, table, self.config.compact_folders)

    def _set_watermark(self, manifest: dict, newest: datetime, at: datetime) -> None:
        """The feed's watermark, which never goes back."""
        newest = max(manifest["state"].get("watermark", ""), str(newest))
        manifest["state"]["watermark"] = newest
        row = self.spark.createDataFrame([("events", datetime.fromisoformat(newest), at.replace(tzinfo=None))], "feed string, watermark_ts timestamp_ntz, updated_at timestamp_ntz")
        self.store.replace(manifest, "load_watermark", self.store.write("load_watermark", row))

    def _record(self, manifest: dict, stats: MergeStats, at: datetime, quarantine_pct: float, began: float, alerts: list[Alert]) -> MergeStats:
        row = (stats.batch_id, at, stats.state, stats.records_in, stats.staged, stats.inserted, stats.updated, stats.duplicates_suppressed, stats.late_arrivals, float(quarantine_pct), 1000 * (time.monotonic() - began))
        self._add(manifest, "pipeline_metrics", [row])
        self._add(manifest, "alerts", [a.row() for a in alerts])
        manifest["state"]["active"] = list(self.registry.active)
        self.store.commit(manifest)
        return stats

    def _add(self, manifest: dict, table: str, rows: list[tuple]) -> None:
        if rows:
            frame = self.spark.createDataFrame(rows, self.store.read(table, {"tables": {}}).schema)
            self.store.append(manifest, table, self.store.write(table, frame))

    def process(self, records: DataFrame, batch_id: str, at: datetime | None = None) -> MergeStats:
        """Deliver and merge one batch of raw records, with the monitors."""
        at = at or datetime.now(timezone.utc)
        if is_done(self.store.manifest()["state"], batch_id):
            return MergeStats(batch_id, IDLE)
        batch, bronze, note, alerts = self._received(batch_id, records, at)
        return self.merge(self._rows([bronze] if batch.accepted else []), batch_id, at, batch.quarantine_pct, note, alerts)

    def enqueue(self, records: DataFrame, batch_id: str, at: datetime | None = None) -> BatchResult | None:
        """Deliver a batch and queue it for ``merge_queued``; None for one that was taken before."""
        at = at or datetime.now(timezone.utc)
        if is_done(self.store.manifest()["state"], batch_id):
            return None
        batch, bronze, note, alerts = self._received(batch_id, records, at)
        manifest = self.store.manifest()
        state = manifest["state"]
        state.update(note)
        state["queue"] = [*state.get("queue", []), {"batch": batch_id, "bronze": bronze, "accepted": batch.accepted, "quarantined": batch.quarantined, "at": at.isoformat()}]
        self._add(manifest, "alerts", [a.row() for a in alerts])
        self.store.commit(manifest)
        return batch

    def merge_queued(self, at: datetime | None = None, force: bool = False) -> MergeStats:
        """Merge all queued batches as one, if the oldest has waited for the merge interval or ``force`` is set.

        Batches whose own share of quarantined records trips the breaker are held back; the others go on.
        """
        at = at or datetime.now(timezone.utc)
        queue = self.store.manifest()["state"].get("queue", [])
        if not queue or not force and at - datetime.fromisoformat(queue[0]["at"]) < timedelta(seconds=self.config.merge_interval_seconds):
            return MergeStats("queue", IDLE)
        total = lambda q: BatchResult(q["accepted"], q["quarantined"])
        held = [q for q in queue if total(q).quarantine_pct > self.config.breaker_pct]
        good = [q for q in queue if q not in held]
        if held:
            manifest = self.store.manifest()
            state = manifest["state"]
            state["queue"] = good
            state["blocked"] += [q["batch"] for q in held]
            self._record(manifest, MergeStats("+".join(q["batch"] for q in held), BLOCKED_BREAKER), at.replace(tzinfo=None), max(total(q).quarantine_pct for q in held), time.monotonic(), [])
            if not good:
                return MergeStats(held[-1]["batch"], BLOCKED_BREAKER)
        name = f"{good[0]['batch']}..{good[-1]['batch']}" if len(good) > 1 else f"{good[0]['batch']}."
        pct = BatchResult(sum(q["accepted"] for q in good), sum(q["quarantined"] for q in good)).quarantine_pct
        return self.merge(self._rows([q["bronze"] for q in good if q["accepted"]]), name, at, pct, {"queue": []}, [], [q["batch"] for q in good])

    def expire(self, at: datetime | None = None) -> list[str]:
        """Take days older than the retention out of the facts and their reconciliation; the days that went."""
        at = at or datetime.now(timezone.utc)
        first = str((at - timedelta(days=self.config.retention_days)).date())
        manifest = self.store.manifest()
        gone = {day for table in ("fact_shipment_events", "fact_daily_shipment_recon") for day in self.store.expire(manifest, table, first)}
        if gone:
            self.store.commit(manifest)
        return sorted(gone)

    def start(self, log_path: str, checkpoint: str, available_now: bool = True, queued: bool = False):
        """Run the pipeline as a stream over the log; a restarted query goes on where it stopped.

        With ``queued`` micro-batches are delivered as they come and merged
        together at the merge interval; call ``merge_queued(force=True)`` after the last.
        """
        writer = stream_log(self.spark, log_path).writeStream.option("checkpointLocation", checkpoint)
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{self.config.buffer_seconds} seconds")

        def each(rows: DataFrame, n: int) -> None:
            records = rows.select("raw_payload", "kinesis_seq", "shard_id")
            if queued:
                self.enqueue(records, f"stream-{n}")
                self.merge_queued()
            else:
                self.process(records, f"stream-{n}")

        return writer.foreachBatch(each).start()
