"""Contract remediation and replay of quarantined records."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import functions as F

from waybill.operators import audit
from waybill.sources import lake
from waybill.streaming.pipeline import MergeStats, Pipeline


@dataclass
class ReplayResult:
    scanned: int
    recovered: int
    still_rejected: int
    duplicates: int
    merge: MergeStats | None


def remediate(pipeline: Pipeline, version: str, at: datetime, actor: str = "operator", note: str = "") -> tuple[bool, list[str]]:
    """Activate a contract and log whether it is compatible with v1; a breaking one is recorded, not refused."""
    registry = pipeline.registry
    ok, problems = registry.check_compatibility("v1", version)
    registry.activate(version, actor, note, at)
    manifest, store = pipeline.store.manifest(), pipeline.store
    rows = pipeline.spark.createDataFrame([(at.replace(tzinfo=None), version, "FULL" if ok else "BREAKING", actor, "; ".join(problems) or note)], store.read("schema_change_log", {"tables": {}}).schema)
    store.append(manifest, "schema_change_log", store.write("schema_change_log", rows))
    manifest["state"]["active"] = list(registry.active)
    store.commit(manifest)
    return ok, problems


def replay(pipeline: Pipeline, batch_id: str, at: datetime) -> ReplayResult:
    """Validate all quarantined records again and merge what passes now.

    The recovered go through the normal delivery.  Files that were scanned leave
    the active quarantine (they stay on disk); what is still rejected is
    quarantined anew.  Accepted rows of batches that were held back go along.
    """
    spark, state = pipeline.spark, pipeline.store.manifest()["state"]
    folders = state["quarantine"]
    if not folders and not state["blocked"]:
        return ReplayResult(0, 0, 0, 0, None)
    before = audit.duplicates(pipeline.store.read("fact_shipment_events"), "event_id").count()
    held = spark.createDataFrame([], "raw_payload string")
    for folder in folders:
        held = held.unionByName(lake.read_quarantine(spark, folder).select("raw_payload"))
    records = held.withColumn("kinesis_seq", F.lit(-1).cast("long")).withColumn("shard_id", F.lit("replay"))
    batch, bronze, quarantine = pipeline.deliver(records, batch_id, at)
    note = {"quarantine": [quarantine] if batch.quarantined else [], "archive": [*state.get("archive", []), *folders]}
    paths = [bronze] if batch.accepted else []
    held_back = state["blocked"]
    blocked = [f"{pipeline.root}/bronze/batch={b}" for b in held_back]
    fs = pipeline.store
    paths += [p for p in blocked if fs._fs.exists(fs._path(f"{p}/_SUCCESS")) and any(s.isDirectory() for s in fs._fs.listStatus(fs._path(p)))]
    merged = None
    if paths:
        note["blocked"] = []
        merged = pipeline.merge(pipeline._rows(paths), batch_id, at, 0.0, note, None, [batch_id, *held_back])
    else:
        manifest = pipeline.store.manifest()
        manifest["state"].update(note)
        pipeline.store.commit(manifest)
    after = audit.duplicates(pipeline.store.read("fact_shipment_events"), "event_id").count()
    return ReplayResult(batch.total, batch.accepted, batch.quarantined, after - before, merged)
