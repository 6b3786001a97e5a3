import json
from datetime import timedelta

import pytest
from conftest import NOW, payload, records
from pyspark.sql import functions as F

from waybill.config import Config
from waybill.contracts import Registry
from waybill.costs import CostModel
from waybill.operators.monitors import BatchResult, MonitorSuite, readings
from waybill.streaming.pipeline import Pipeline
from waybill.streaming.replay import remediate, replay

V2 = {"delivery_window": ..., "delivery": {"window_start": NOW.isoformat(), "window_end": NOW.isoformat()}}
V3 = {"geo": ..., "position": {"latitude": 51.5, "longitude": -0.12}}


@pytest.mark.parametrize(
    "active, change, version, reason",
    [
        (["v1"], {}, "v1", ""),
        (["v1"], V2, "unknown", "delivery"),
        (["v1", "v2"], V2, "v2", ""),
        (["v1", "v2", "v3"], V3, "v3", ""),
        (["v1", "v2", "v3"], V2, "v2", ""),
        (["v1", "v2", "v3"], V2 | V3, "unknown", ""),
        (["v1"], {"surprise": "x"}, "unknown", "surprise"),
        (["v1"], {"metadata": {"new": [1, 2]}}, "v1", ""),
        (["v1", "v2", "v3"], {"geo": ..., "delivery_window": ...}, "v3", ""),
        (["v1", "v2"], {"delivery_window": ..., "delivery": None}, "unknown", "post-mapping"),
        (["v1"], {"event_id": "short"}, "unknown", "event_id"),
        (["v1"], {"temperature_c": "1.5"}, "unknown", "temperature_c"),
        (["v1"], {"geo": {"lat": 91, "lon": 0}}, "unknown", "geo.lat"),
        (["v1"], {"geo": {"lat": 9}}, "unknown", "lon"),
        (["v1"], {"status": "lost"}, "unknown", "status"),
        (["v1"], {"status": None, "geo": None, "delivery_window": None}, "v1", ""),
    ],
)
def test_verdicts(spark, active, change, version, reason):
    row = Registry(active=active).verdicts(records(spark, [payload(1, **change)])).first()
    assert row.schema_version == version and row.ok == (version != "unknown")
    assert reason in row.reason


def test_broken_json_is_rejected(spark):
    rows = Registry().verdicts(records(spark, ["{", "[1]", "", "null"])).collect()
    assert not any(r.ok for r in rows) and all(r.reason for r in rows)


def test_compatibility():
    ok, problems = Registry().check_compatibility("v1", "v2")
    assert not ok and problems == ["delivery_window: gone"]


def test_merge_is_idempotent_and_keeps_order(spark, tmp_path):
    p = Pipeline(spark, str(tmp_path))
    first = p.process(records(spark, [payload(i) for i in range(50)] + [payload(0)] * 9), "a", NOW)
    assert (first.state, first.inserted, first.duplicates_suppressed) == ("PUBLISHED", 50, 9)
    assert p.process(records(spark, [payload(1)]), "a", NOW).state == "IDLE"
    again = p.process(records(spark, [payload(i) for i in range(50)]), "b", NOW + timedelta(seconds=9))
    assert (again.inserted, again.unchanged) == (0, 50)
    later = (NOW + timedelta(hours=1)).isoformat()
    p.process(records(spark, [payload(900, shipment_id="SHP-20260302-00000003", status="delivered", event_ts=later)]), "c", NOW + timedelta(hours=2))
    early = (NOW - timedelta(hours=3)).isoformat()
    p.process(records(spark, [payload(901, shipment_id="SHP-20260302-00000003", status="pickup", event_ts=early)]), "d", NOW + timedelta(hours=2))
    row = p.store.read("fact_shipment_status_current").where("shipment_id = 'SHP-20260302-00000003'").first()
    assert (row.current_status, row.event_count) == ("delivered", 3)
    facts = p.store.read("fact_shipment_events")
    assert facts.count() == 52 and facts.select("event_id").distinct().count() == 52
    assert p.store.read("sat_shipment_status").count() == 52
    moved = p.process(records(spark, [payload(5, event_ts=(NOW + timedelta(days=1)).isoformat())]), "e", NOW + timedelta(days=1))
    assert moved.updated == 1 and p.store.read("fact_shipment_events").count() == 52


def test_late_breaker_and_audit(spark, tmp_path):
    p = Pipeline(spark, str(tmp_path))
    stale = p.process(records(spark, [payload(1, event_ts=(NOW - timedelta(hours=30)).isoformat())]), "late", NOW)
    assert stale.state == "NO_NEW_ROWS" and p.store.read("late_arrivals").first().age_hours == 30.0
    assert p.process(records(spark, [payload(2), payload(3, surprise=1)]), "bad", NOW).state == "BLOCKED_CIRCUIT_BREAKER"
    nulls = p.process(records(spark, [payload(10 + i, delivery_window=None) for i in range(20)]), "nulls", NOW)
    assert nulls.state == "BLOCKED_AUDIT" and "null rate" in nulls.failures[0]
    assert p.store.read("fact_shipment_events").count() == 0
    assert {a.monitor for a in p.monitors.alerts} >= {"contract_violation", "circuit_breaker", "null_rate"}


def test_two_step_replay(spark, tmp_path):
    p = Pipeline(spark, str(tmp_path))
    drifted = [payload(i, **V2) for i in range(6)] + [payload(10 + i, **V3) for i in range(4)]
    assert p.process(records(spark, drifted), "x", NOW).state == "BLOCKED_CIRCUIT_BREAKER"
    remediate(p, "v2", NOW)
    one = replay(p, "r1", NOW + timedelta(seconds=20))
    assert (one.scanned, one.recovered, one.still_rejected, one.duplicates) == (10, 6, 4, 0)
    remediate(p, "v3", NOW)
    two = replay(p, "r2", NOW + timedelta(seconds=40))
    assert (two.recovered, two.still_rejected, two.duplicates) == (4, 0, 0)
    facts = p.store.read("fact_shipment_events")
    assert {r.schema_version: r["count"] for r in facts.groupBy("schema_version").count().collect()} == {"v2": 6, "v3": 4}
    assert facts.where("geo_lat is not null and delivery_window_start is not null").count() == 10
    assert Pipeline(spark, str(tmp_path)).registry.active == ["v1", "v2", "v3"]


def test_stream_restart(spark, tmp_path):
    from waybill.sources.log import append_log, read_log

    p = Pipeline(spark, str(tmp_path / "p"), Config(lateness_hours=10**6))
    log, check = str(tmp_path / "log"), str(tmp_path / "check")
    for n in (0, 30):
        rows = records(spark, [payload(n + i, vehicle_id=f"VEH-{i:06d}") for i in range(30)])
        append_log(rows.select("raw_payload", F.col("kinesis_seq").alias("seq"), F.lit(NOW).alias("arrival_ts")), log, 4, n)
        p.start(log, check).awaitTermination()
    assert p.store.read("fact_shipment_events").count() == 60
    assert read_log(spark, log).select("shard_id").distinct().count() == 4


def test_monitors():
    config, suite = Config(), MonitorSuite()
    bad = BatchResult(accepted=30, null_counts={"delivery_window_start": 30})
    null_rate = lambda: [x for x in readings(bad, 0, [], config) if x.monitor == "null_rate"]
    assert [a.severity for a in suite.judge(null_rate(), NOW)] == ["CRITICAL"] and not suite.judge(null_rate(), NOW + timedelta(seconds=14))
    restarted = MonitorSuite(config, json.loads(json.dumps(suite.state)))
    assert not restarted.judge(null_rate(), NOW + timedelta(seconds=14)) and restarted.judge(null_rate(), NOW + timedelta(seconds=15))
    for i in range(6):
        good = BatchResult(accepted=1000, null_counts={"delivery_window_start": 100 + i % 2})
        assert not suite.evaluate(good, 30, NOW)
    found = suite.evaluate(BatchResult(accepted=1000, null_counts={"delivery_window_start": 149}), 31, NOW)
    assert [(a.monitor, a.severity) for a in found] == [("freshness", "WARNING"), ("business_canary", "CRITICAL")]
    torn = suite.evaluate(BatchResult(accepted=90, quarantined=10, violations_by_field={"b": 3, "a": 3, "c": 9}), 0, NOW)
    assert [(a.monitor, a.severity) for a in torn] == [("contract_violation", "CRITICAL"), ("circuit_breaker", "CRITICAL")]
    assert list(torn[0].detail["fields"]) == ["c", "a", "b"] and suite.critical_count == 4 and suite.recent(1) == torn[1:]
    mild = MonitorSuite().evaluate(BatchResult(accepted=990, quarantined=10), 0, NOW)
    assert [(a.monitor, a.severity) for a in mild] == [("contract_violation", "WARNING")]


def test_audit_block_keeps_quarantine_and_late_rows(spark, tmp_path):
    p = Pipeline(spark, str(tmp_path))
    late = (NOW - timedelta(hours=30)).isoformat()
    rows = [payload(i, delivery_window=None) for i in range(24)] + [payload(50, surprise=1), payload(51, event_ts=late)]
    stats = p.process(records(spark, rows), "mixed", NOW)
    state = p.store.manifest()["state"]
    assert stats.state == "BLOCKED_AUDIT" and len(state["quarantine"]) == 1 and state["blocked"] == ["mixed"]
    assert p.store.read("late_arrivals").count() == 1 and p.store.read("fact_shipment_events").count() == 0
    assert p.process(records(spark, rows), "mixed", NOW).state == "IDLE"
    p.config = Config(null_alert_pct=100.0)
    again = replay(p, "r", NOW + timedelta(seconds=9))
    assert (again.scanned, again.recovered, again.merge.state) == (1, 0, "PUBLISHED") and again.merge.inserted == 24
    assert not p.store.manifest()["state"]["blocked"] and len(p.store.manifest()["state"]["quarantine"]) == 1


def test_failed_batch_is_rolled_back_and_retried_once(spark, tmp_path, monkeypatch):
    from waybill.operators import vault
    from waybill.sources import lake

    p = Pipeline(spark, str(tmp_path))
    rows = records(spark, [payload(i) for i in range(30)] + [payload(90, surprise=1)])

    def broken(*_):
        raise OSError("disk")

    with monkeypatch.context() as m:
        m.setattr(vault, "load", broken)
        with pytest.raises(OSError):
            p.process(rows, "a", NOW)
    assert [r.state for r in p.store.read("pipeline_metrics").collect()] == ["ROLLED_BACK"]
    assert p.store.read("fact_shipment_events").count() == 0 and p.store.read("alerts").count() == 0
    # A retry in another hour, by another driver, takes the place of the first delivery.
    p = Pipeline(spark, str(tmp_path))
    assert p.process(rows, "a", NOW + timedelta(hours=1)).inserted == 30
    assert lake.read_bronze(spark, f"{tmp_path}/bronze/batch=a").count() == 30 and lake.read_quarantine(spark, f"{tmp_path}/quarantine/batch=a").count() == 1
    assert p.store.read("alerts").count() == 1 and len(p.store.manifest()["state"]["quarantine"]) == 1


def test_incremental_equals_full(spark, tmp_path):
    """Random splits with hub changes, late events, redelivery and corrections: the marts equal those of one pass."""
    import random

    from waybill.operators import marts, merge, vault

    r = random.Random(5)
    events = []
    for i in range(90):
        at = NOW - timedelta(hours=r.randrange(0, 80))
        events.append(payload(i, shipment_id=f"SHP-{i % 7:08d}", hub_code=f"HUB-{r.choice(['PT', 'FI', 'NZ'])}-{r.randrange(3):03d}", event_ts=at.isoformat(), status=r.choice(["pickup", "in_transit", "exception", "delivered"]), event_type=r.choice(["status", "gps_ping", "hub_scan"])))
    config = Config(lateness_hours=1000, retention_days=1000)
    p = Pipeline(spark, str(tmp_path), config)
    sent = events + r.sample(events, 10) + [e | {"status": "delivered"} for e in r.sample(events, 8)]
    batches = [sent[:40], sent[40:45], sent[45:80], sent[80:100], sent[100:]]
    for i, batch in enumerate(batches):
        assert p.process(records(spark, batch), f"b{i}", NOW + timedelta(seconds=i)).state == "PUBLISHED"
    facts, snapshot = p.store.read("fact_shipment_events"), p.store.read("fact_shipment_status_current")
    last = {e["event_id"]: e for e in sent}
    one = Pipeline(spark, str(tmp_path / "one"), config)
    assert one.process(records(spark, list(last.values())), "all", NOW).inserted == 90
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    numbers = ["recon_date", "hub_code", "shipments", "events", "delivered", "exceptions", "window_breaches"]
    assert same(p.store.read("fact_daily_shipment_recon").select(*numbers), marts.recon(facts, snapshot).select(*numbers))
    assert same(facts.drop("updated_at", "ingest_ts"), one.store.read("fact_shipment_events").drop("updated_at", "ingest_ts"))
    # What events said before their correction stays known to a snapshot that only looks ahead.
    assert same(snapshot.select("shipment_id", "last_event_ts", "first_event_ts", "last_hub_code", "event_count"), one.store.read("fact_shipment_status_current").select("shipment_id", "last_event_ts", "first_event_ts", "last_hub_code", "event_count"))
    for table in vault.LOADS:
        rows = p.store.read(table)
        assert rows.count() == rows.select(*vault.LOADS[table][1]).distinct().count()
        assert one.store.read(table).select(*vault.LOADS[table][1]).exceptAll(rows.select(*vault.LOADS[table][1])).count() == 0
    assert p.store.read("dim_vehicle").count() == 1 and same(p.store.read("dim_facility"), one.store.read("dim_facility"))
    assert merge.fact_rows and p.store.duplicate_check() == 0


def test_queued_batches_merge_as_one(spark, tmp_path):
    p = Pipeline(spark, str(tmp_path))
    for i in range(3):
        assert p.enqueue(records(spark, [payload(10 * i + k) for k in range(4)]), f"stream-{i}", NOW + timedelta(seconds=i)).accepted == 4
    p.enqueue(records(spark, [payload(99, surprise=1)]), "stream-3", NOW + timedelta(seconds=3))
    assert p.enqueue(records(spark, [payload(1)]), "stream-1", NOW) is None
    assert p.merge_queued(NOW + timedelta(seconds=3)).state == "IDLE" and p.store.read("fact_shipment_events").count() == 0
    p = Pipeline(spark, str(tmp_path))
    assert (p.merge_queued(NOW + timedelta(seconds=4)).inserted, p.store.read("fact_shipment_events").count()) == (12, 12)
    state = p.store.manifest()["state"]
    assert state["stream"] == 2 and state["blocked"] == ["stream-3"] and not state["queue"]
    assert p.process(records(spark, [payload(5)]), "stream-2", NOW).state == "IDLE"
    assert len(Pipeline(spark, str(tmp_path)).monitors.state["shares"]) == 3


def test_store_questions_compaction_and_retention(spark, tmp_path):
    p = Pipeline(spark, str(tmp_path), Config(lateness_hours=10**5, compact_folders=2))
    assert p.bootstrap(NOW) == 365 and p.bootstrap(NOW) == 0
    for i in range(4):
        day = (NOW - timedelta(days=100 * (i == 0))).isoformat()
        p.process(records(spark, [payload(10 * i + k, event_ts=day, delivery_window=None if k == 0 else payload()["delivery_window"]) for k in range(10)]), f"b{i}", NOW + timedelta(seconds=i))
    store = p.store
    assert store.counts()["fact_shipment_events"] == 40 and store.duplicate_check() == 0
    assert store.null_rate(as_of=NOW.replace(tzinfo=None) + timedelta(seconds=3)) == 10.0 and store.null_rate("status", NOW.replace(tzinfo=None)) == 0.0
    assert store.sql("SELECT count(*) AS n FROM fact_shipment_events e JOIN dim_shipment s USING (shipment_key) JOIN dim_date d ON d.date_key = e.event_date").first().n == 30
    assert store.sql("SELECT max(watermark_ts) AS w FROM load_watermark").first().w == NOW.replace(tzinfo=None) + timedelta(seconds=3)
    assert max(len(paths) for parts in store.manifest()["tables"].values() for paths in parts.values()) <= 3
    before = {t: store.read(t).count() for t in store.manifest()["tables"]}
    assert store.vacuum(keep=1) > 0 and {t: store.read(t).count() for t in store.manifest()["tables"]} == before
    assert p.expire(NOW) == [str((NOW - timedelta(days=100)).date())] and store.read("fact_shipment_events").count() == 30


def test_watermark_never_goes_back(spark, tmp_path):
    p = Pipeline(spark, str(tmp_path))
    p.process(records(spark, [payload(1)]), "a", NOW + timedelta(hours=1))
    p.process(records(spark, [payload(2)]), "b", NOW)
    assert p.store.read("load_watermark").first().watermark_ts == (NOW + timedelta(hours=1)).replace(tzinfo=None)


def test_costs():
    assert CostModel.from_run(4270, 100, 5600, 1000) == CostModel(42.7, 5.6) and CostModel.from_run(1, 2, 0, 0) == CostModel(1.0, 1.0)
    assert CostModel(30.0, 6.2).summary()["under_budget"] and not CostModel(1.0, 6.2).summary()["under_budget"]
    assert [round(CostModel(r, 5.6).summary()["proposed"]) for r in (1, 5, 10, 43)] == [61723, 23659, 18901, 15249]
