import pytest
from conftest import NOW
from pyspark.sql import functions as F

from waybill.config import Config
from waybill.contracts import Registry
from waybill.sources.generator import generate, plan_incidents
from waybill.sources.log import Consumer, envelope, lag, put_records


def test_generator(spark):
    c = Config(redelivery_rate=0.0)
    rows = generate(spark, 3000, NOW, c)
    assert rows.collect() == generate(spark, 3000, NOW, c).collect()
    assert Registry().verdicts(rows).where("ok").count() == 3000
    drifted = Registry().verdicts(generate(spark, 3000, NOW, c, {"partner_courier_api": ["window_rename", "geo_move"]}))
    sources = drifted.where("not ok").select(F.get_json_object("raw_payload", "$.source").alias("s")).distinct().collect()
    assert [r.s for r in sources] == ["partner_courier_api"]
    with pytest.raises(ValueError):
        generate(spark, 1, NOW, c, {"x": ["other"]})
    again = generate(spark, 3000, NOW, Config(redelivery_rate=0.1))
    assert 3100 < again.count() < 3600 and again.select("seq").distinct().count() == 3000


def test_shards_spread(spark):
    rows = envelope(generate(spark, 2000, NOW), 8).groupBy("shard_id").count().collect()
    total = sum(r["count"] for r in rows)
    assert len(rows) == 8 and max(r["count"] for r in rows) < 0.35 * total


def test_incidents():
    plan = plan_incidents(3, 90)
    assert plan == plan_incidents(3, 90) and 10 <= plan["first_at"] <= 24 and 5 <= plan["second_after"] <= 10
    assert plan_incidents(3, 90, first_at=2.0)["first_at"] == 2.0


def test_generator_lifecycle(spark):
    """Shipments move on, keep their vehicle and hub, and sources have their own metadata, whatever part is generated."""
    import json

    c = Config(redelivery_rate=0.0, vehicles=40, late_rate=0.05)
    whole = [json.loads(r.raw_payload) for r in generate(spark, 2000, NOW, c).orderBy("seq").collect()]
    parts = [json.loads(r.raw_payload) for first in (0, 700) for r in generate(spark, 700 if not first else 1300, NOW, c, first=first).orderBy("seq").collect()]
    assert [e["event_id"] for e in whole] == [e["event_id"] for e in parts] and [e.get("status") for e in whole] == [e.get("status") for e in parts]
    flow, seen, own = ["in_transit", "exception", "delivered"], {}, {}
    for e in whole:
        if e["event_type"] == "status":
            k = seen[e["shipment_id"]] = seen.get(e["shipment_id"], -1) + 1
            assert e["status"] == flow[min(k, 2)]
        else:
            assert "status" not in e
        assert ("vehicle_id" in e) == (e["event_type"] != "hub_scan")
        for name in ("vehicle_id", "hub_code"):
            if name in e:
                assert own.setdefault((e["shipment_id"], name), e[name]) == e[name]
    keys = {"telematics_gateway": {"device_fw", "signal_dbm", "odometer_km"}, "hub_scanner_net": {"conveyor", "scan_quality", "operator_id"}, "partner_courier_api": {"partner_ref", "sla_tier"}, "driver_mobile_app": {"app_version", "battery_pct"}}
    assert all(set(e["metadata"]) == keys[e["source"]] for e in whole if e.get("metadata")) and 0.2 < sum(not e.get("metadata") for e in whole) / 2000 < 0.3
    late = sum(e["event_ts"] < NOW.isoformat() for e in whole)
    assert 60 < late < 140 and len({e["hub_code"][4:6] for e in whole}) > 15


def test_throttle_and_consumer(spark, tmp_path):
    c = Config(redelivery_rate=0.0, events_per_second=100)
    log, place = str(tmp_path / "log"), str(tmp_path / "place.json")
    put = put_records(generate(spark, 400, NOW, c), log, 4, 20)
    assert (put.admitted, put.throttled, put.capacity_used_pct) == (320, 80, 100.0)
    consumer = Consumer(spark, log, place)
    assert consumer.lag() == 320
    first = consumer.read(100).persist()
    assert first.count() == 100 and consumer.lag() == 320
    consumer.commit(first)
    assert consumer.lag() == 220 and Consumer(spark, log, place).lag() == 220
    rest = Consumer(spark, log, place).read(1000)
    assert rest.count() == 220 and rest.join(first, "kinesis_seq").count() == 0
    assert [r.kinesis_seq for r in rest.collect()] == sorted(r.kinesis_seq for r in rest.collect())
    consumer.rewind(80)
    assert consumer.lag() == 300 and consumer.read(1000).join(first, "kinesis_seq").count() == 80
    assert lag({"sources": [{"metrics": {"numFilesOutstanding": "3"}}, {}]}) == 3


def test_config_from_env():
    c = Config.from_env({"WAYBILL_SEED": "9", "WAYBILL_EVENTS_PER_SECOND": "5", "WAYBILL_LATE_RATE": "0.5", "OTHER": "1"})
    assert (c.seed, c.events_per_second, c.late_rate, c.shards) == (9, 5, 0.5, 8)
