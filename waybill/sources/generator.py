"""A seeded synthetic source of shipment records, as a DataFrame."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.config import Config

# Sources and event types with their cumulative shares in percent, countries, lifecycle.
SOURCES = [("telematics_gateway", 48), ("hub_scanner_net", 70), ("partner_courier_api", 88), ("driver_mobile_app", 100)]
EVENT_TYPES = [("gps_ping", 55), ("temperature", 77), ("status", 90), ("hub_scan", 100)]
COUNTRIES = "GB IE FR DE NL BE ES PT IT PL CZ AT SE NO DK FI CH RO HU GR US CA MX BR AE SA ZA IN SG JP AU NZ".split()
FLOW = ["pickup", "in_transit", "exception", "delivered"]
DRIFTS = ("window_rename", "geo_move")

#: Events of a shipment, one for each round of the shipments under way.
LIFE = 40


def draw(name: str, seed: int, n: int, key: Column) -> Column:
    """A number in 0..n-1 for each key, independent for each name; n is under 2**32."""
    digest = F.md5(F.concat_ws("|", F.lit(name), F.lit(str(seed)), key.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(n))


def _pick(choices, drawn: Column) -> Column:
    out = F.lit(choices[-1][0])
    for value, below in reversed(choices[:-1]):
        out = F.when(drawn < below, F.lit(value)).otherwise(out)
    return out


def event_kinds(ids: DataFrame, config: Config) -> DataFrame:
    """(id, source, event_type, late): late in seconds, 0 for most."""
    seed, key = config.seed, F.col("id")
    late = F.when(draw("late", seed, 10_000, key) < int(config.late_rate * 10_000), draw("age", seed, 23 * 3600, key) + 300).otherwise(0)
    return ids.select("id", _pick(SOURCES, draw("source", seed, 100, key)).alias("source"), _pick(EVENT_TYPES, draw("type", seed, 100, key)).alias("event_type"), late.alias("late"))


def lifecycle(config: Config) -> tuple[Column, Column, Column]:
    """Of an event id: the shipment's number, the event's place in its life, and how many of its status events came before.

    ``vehicles`` / 4 shipments are under way at a time and take turns, so that all
    three follow from the id alone, whatever part of a feed is generated.
    """
    under_way, key = max(1, config.vehicles // 4), F.col("id")
    place = F.floor(key / under_way) % LIFE
    shipment = F.floor(key / (under_way * LIFE)) * under_way + key % under_way
    is_status = lambda k: draw("type", config.seed, 100, key - (place - k) * under_way).between(EVENT_TYPES[1][1], EVENT_TYPES[2][1] - 1)
    earlier = F.when(place > 0, F.size(F.filter(F.sequence(F.lit(0).cast("long"), place - 1), is_status))).otherwise(0)
    return shipment.cast("long"), place.cast("long"), earlier


def _metadata(seed: int) -> Column:
    """Each source's own extra fields; null for a quarter of the records."""
    key = F.col("id")
    whole = lambda name, low, high: (draw(name, seed, high - low + 1, key) + low).cast("int")
    text = lambda pattern, *parts: F.format_string(pattern, *parts)
    choice = lambda name, *values: F.element_at(F.array(*[F.lit(v) for v in values]), whole(name, 1, len(values)))
    shapes = {
        "telematics_gateway": {"device_fw": text("4.%d.%d", whole("fw", 0, 9), whole("patch", 0, 20)), "signal_dbm": whole("signal", -115, -60), "odometer_km": whole("odometer", 10_000, 4_800_000) / 10},
        "hub_scanner_net": {"conveyor": text("CV-%02d", whole("conveyor", 1, 48)), "scan_quality": choice("scan", "ok", "ok", "ok", "reread"), "operator_id": text("OP-%04d", whole("operator", 1, 900))},
        "partner_courier_api": {"partner_ref": F.substring(F.md5(F.concat(F.lit(f"ref|{seed}|"), key.cast("string"))), 1, 12), "sla_tier": choice("tier", "standard", "express", "cold_chain")},
        "driver_mobile_app": {"app_version": text("2.%d", whole("app", 0, 6)), "battery_pct": whole("battery", 5, 100)},
    }
    out = F.lit(None).cast("string")
    for source, fields in shapes.items():
        out = F.when(F.col("source") == source, F.to_json(F.struct(*[c.alias(name) for name, c in fields.items()]))).otherwise(out)
    return F.when(draw("metadata", seed, 4, key) > 0, out)


def generate(spark: SparkSession, n: int, start: datetime, config: Config | None = None, drift: dict[str, list[str]] | None = None, first: int = 0) -> DataFrame:
    """``n`` records (raw_payload, seq, arrival_ts) from ``start`` on, and some of them again.

    Shipments move on from pickup by their status events; vehicle, hub, delivery
    window and the start of the way are a shipment's own.  ``drift`` maps a source
    to the kinds it shows; kinds can't be undone by later calls that name them
    again.  The same arguments give the same records.
    """
    c, drift = config or Config(), drift or {}
    for kinds in drift.values():
        for kind in kinds:
            if kind not in DRIFTS:
                raise ValueError(f"no drift {kind}")
    seed, id_ = c.seed, F.col("id")
    rows = event_kinds(spark.range(first, first + n), c)
    at = F.timestamp_micros(F.lit(int(start.timestamp() * 1e6)) + ((id_ - first) * (1_000_000 / c.events_per_second)).cast("long"))
    shipment, place, earlier = lifecycle(c)
    rows = rows.withColumns({"arrival_ts": at, "shipment": shipment, "place": place, "earlier": earlier})
    own = lambda name, size: draw(name, seed, size, F.col("shipment"))
    # A way of its own heading and pace, and a temperature that wavers around the shipment's.
    lat = F.greatest(F.lit(-89.9), F.least(F.lit(89.9), F.round(own("lat", 12_400_000) / 1e5 - 56 + F.col("place") * (own("north", 10_001) - 5000) / 1e5, 5)))
    lon = F.greatest(F.lit(-179.9), F.least(F.lit(179.9), F.round(own("lon", 30_000_000) / 1e5 - 125 + F.col("place") * (own("east", 10_001) - 5000) / 1e5, 5)))
    celsius = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.round(own("celsius", 3001) / 100 - 22 + (draw("waver", seed, 81, id_) - 40) / 100, 2)))
    iso = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    event_ts = F.timestamp_micros(F.unix_micros("arrival_ts") - F.col("late") * 1_000_000)
    promised = int(start.timestamp()) // 86400 * 86400 + (own("promise", 24 * 60) + 30) * 60
    hours = F.element_at(F.array(F.lit(2), F.lit(4), F.lit(8)), (own("hours", 3) + 1).cast("int"))
    opens, closes = iso(F.timestamp_seconds(promised)), iso(F.timestamp_seconds(promised + hours * 3600))
    hub = own("hub", c.hubs)
    country = F.element_at(F.array(*[F.lit(x) for x in COUNTRIES]), (hub % len(COUNTRIES) + 1).cast("int"))
    drifted = lambda kind: F.col("source").isin(*[s for s, kinds in drift.items() if kind in kinds] or [""])
    payload = F.to_json(
        F.struct(
            F.md5(F.concat_ws("|", F.lit(str(seed)), id_.cast("string"))).alias("event_id"),
            "event_type",
            iso(event_ts).alias("event_ts"),
            F.concat(F.lit(f"SHP-{start:%Y%m%d}-"), F.lpad(F.col("shipment").cast("string"), 8, "0")).alias("shipment_id"),
            F.when(F.col("event_type") != "hub_scan", F.concat(F.lit("VEH-"), F.lpad(own("vehicle", c.vehicles).cast("string"), 6, "0"))).alias("vehicle_id"),
            F.concat(F.lit("HUB-"), country, F.lit("-"), F.lpad(hub.cast("string"), 3, "0")).alias("hub_code"),
            "source",
            F.when(F.col("event_type") == "status", F.element_at(F.array(*[F.lit(x) for x in FLOW]), F.least(F.col("earlier") + 2, F.lit(len(FLOW))).cast("int"))).alias("status"),
            F.when(F.col("event_type") == "temperature", celsius).alias("temperature_c"),
            F.when(~drifted("geo_move"), F.struct(lat.alias("lat"), lon.alias("lon"))).alias("geo"),
            F.when(drifted("geo_move"), F.struct(lat.alias("latitude"), lon.alias("longitude"))).alias("position"),
            F.when(~drifted("window_rename"), F.struct(opens.alias("start"), closes.alias("end"))).alias("delivery_window"),
            F.when(drifted("window_rename"), F.struct(opens.alias("window_start"), closes.alias("window_end"))).alias("delivery"),
            F.parse_json(_metadata(seed)).alias("metadata"),
        )
    )
    out = rows.select(payload.alias("raw_payload"), id_.alias("seq"), "arrival_ts")
    again = draw("again", seed, 10_000, F.col("seq")) < int(c.redelivery_rate * 10_000)
    copies = F.when(again, F.lit(2)).otherwise(F.lit(1))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop("_copy")


def plan_incidents(seed: int, duration: float, first_at: float | None = None, second_after: float | None = None) -> dict:
    """When the two drifts of a simulated run begin: the first within 10 to 24 s, the second 5 to 10 s after the first replay."""
    import random

    r = random.Random(seed)
    first, second = r.uniform(10, 24), r.uniform(5, 10)
    return {"first_at": min(duration, first_at if first_at is not None else first), "second_after": second_after if second_after is not None else second, "sources": r.sample([s for s, _ in SOURCES], 2), "kinds": list(DRIFTS)}
