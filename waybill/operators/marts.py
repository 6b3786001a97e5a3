"""The status snapshot, the daily reconciliation and the dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill.functions.keys import surrogate

MILESTONES = {"pickup": "pickup_ts", "in_transit": "in_transit_ts", "exception": "exception_ts", "delivered": "delivered_ts"}
#: Snapshot column: the staged column it follows, and the time it was last set.
LAST = {
    "current_status": ("status", "status_ts"),
    "last_vehicle_id": ("vehicle_id", "vehicle_ts"),
    "last_hub_code": ("hub_code", "hub_ts"),
    "last_geo_lat": ("geo_lat", "lat_ts"),
    "last_geo_lon": ("geo_lon", "lon_ts"),
    "delivery_window_start": ("delivery_window_start", "start_ts"),
    "delivery_window_end": ("delivery_window_end", "end_ts"),
}
RESTATED = "late arrivals or replay applied"


def _breached() -> Column:
    late = F.col("delivered_ts") > F.col("delivery_window_end")
    return F.col("delivered_ts").isNotNull() & F.col("delivery_window_end").isNotNull() & F.coalesce(late, F.lit(False))


def status_delta(staged: DataFrame) -> DataFrame:
    """A batch's part of the snapshot: one row a shipment.

    Ties of event time go to the greater event_id, so any order gives one result.
    """
    at = F.struct("event_ts", "event_id")
    last = []
    for name, (column, when) in LAST.items():
        known = F.col(column).isNotNull()
        last.append(F.max_by(F.when(known, F.col(column)), F.when(known, at)).alias(name))
        last.append(F.max(F.when(known, F.col("event_ts"))).alias(when))
    milestones = [F.min(F.when(F.col("status") == s, F.col("event_ts"))).alias(c) for s, c in MILESTONES.items()]
    out = staged.groupBy("shipment_id").agg(F.max("event_ts").alias("last_event_ts"), F.min("event_ts").alias("first_event_ts"), *milestones, *last, F.count(F.lit(1)).alias("event_count"))
    return out.withColumn("shipment_key", surrogate(F.col("shipment_id"))).withColumn("is_window_breached", _breached())


def merge_status(snapshot: DataFrame, delta: DataFrame) -> DataFrame:
    """The snapshot after a batch.

    Every last-known field follows its own time, so batches may come in any
    order; the breach flag is computed anew from the merged fields.
    """
    o, n = snapshot.alias("o"), delta.alias("n")
    joined = o.join(n, F.col("o.shipment_key") == F.col("n.shipment_key"), "full_outer")
    both = lambda f, c: f(F.col(f"o.{c}"), F.col(f"n.{c}"))
    columns = [both(F.coalesce, "shipment_key").alias("shipment_key"), both(F.coalesce, "shipment_id").alias("shipment_id"), both(F.greatest, "last_event_ts").alias("last_event_ts"), both(F.least, "first_event_ts").alias("first_event_ts")]
    columns += [both(F.least, c).alias(c) for c in MILESTONES.values()]
    for name, (_, when) in LAST.items():
        newer = F.col(f"o.{when}").isNull() | (F.col(f"n.{when}") >= F.col(f"o.{when}"))
        columns.append(F.when(F.col(f"n.{when}").isNotNull() & newer, F.col(f"n.{name}")).otherwise(F.col(f"o.{name}")).alias(name))
        columns.append(both(F.greatest, when).alias(when))
    count = F.coalesce("o.event_count", F.lit(0)) + F.coalesce("n.event_count", F.lit(0))
    return joined.select(*columns, count.alias("event_count")).withColumn("is_window_breached", _breached())


def recon(facts: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Daily figures a hub, by each shipment's current hub."""
    s = snapshot.select("shipment_key", F.col("last_hub_code").alias("hub"), "is_window_breached")
    per = facts.join(s, "shipment_key").groupBy("event_date", "shipment_key").agg(
        F.count(F.lit(1)).alias("events"),
        F.coalesce(F.bool_or(F.col("status") == "delivered"), F.lit(False)).alias("delivered"),
        F.coalesce(F.bool_or(F.col("status") == "exception"), F.lit(False)).alias("had_exception"),
        F.coalesce(F.bool_or("is_window_breached"), F.lit(False)).alias("breached"),
        F.min("hub").alias("hub"),
    )
    return per.groupBy(F.col("event_date").alias("recon_date"), F.coalesce("hub", F.lit("UNASSIGNED")).alias("hub_code")).agg(
        F.count(F.lit(1)).alias("shipments"),
        F.sum("events").cast("long").alias("events"),
        F.count_if("delivered").alias("delivered"),
        F.count_if("had_exception").alias("exceptions"),
        F.count_if("breached").alias("window_breaches"),
    )


def restate(old: DataFrame, new: DataFrame, as_of=None) -> DataFrame:
    """``new`` (whole touched days) with restatement marks against ``old`` rows of those days."""
    o = old.select("recon_date", "hub_code", F.col("events").alias("_was"), F.col("restated_at").alias("_at"), F.col("restatement_note").alias("_note"))
    joined = new.join(o, ["recon_date", "hub_code"], "left")
    changed = F.col("_was").isNotNull() & (F.col("_was") != F.col("events"))
    return joined.withColumn("restated_at", F.when(changed, F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("_at"))).withColumn("restatement_note", F.when(changed, F.lit(RESTATED)).otherwise(F.col("_note"))).withColumn("updated_at", F.lit(as_of).cast("timestamp_ntz")).drop("_was", "_at", "_note")


def dim_date(spark, first: str = "2026-01-01", last: str = "2026-12-31", existing: DataFrame | None = None) -> DataFrame:
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date_key"))
    if existing is not None:
        days = days.join(existing, "date_key", "left_anti")
    d = F.col("date_key")
    return days.select("date_key", F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"), F.dayofmonth(d).alias("day"), F.date_format(d, "EEEE").alias("day_name"), F.dayofweek(d).isin(1, 7).alias("is_weekend"))


def vehicle_assignments(facts: DataFrame) -> DataFrame:
    """Intervals in which a vehicle served one shipment, from its events in order."""
    w = Window.partitionBy("vehicle_key").orderBy("event_ts", "event_id")
    rows = facts.where(F.col("vehicle_key").isNotNull()).withColumn("_was", F.lag("shipment_key").over(w))
    starts = rows.where(F.col("_was").isNull() | (F.col("_was") != F.col("shipment_key")))
    to = F.lead("event_ts").over(w)
    return starts.select("vehicle_key", "shipment_key", "facility_key", F.col("event_ts").alias("valid_from"), to.alias("valid_to"), to.isNull().alias("is_current"))


def restated_days(old: DataFrame, new: DataFrame) -> DataFrame:
    """(day): days that may hold events of shipments whose hub or breach flag differs between two snapshots.

    They reach from a shipment's first event to its last, and a day further on
    each side, as an event's day is its payload's own.
    """
    o, n = old.alias("o"), new.alias("n")
    same = F.col("o.last_hub_code").eqNullSafe(F.col("n.last_hub_code")) & F.col("o.is_window_breached").eqNullSafe(F.col("n.is_window_breached"))
    moved = n.join(o, F.col("o.shipment_key") == F.col("n.shipment_key")).where(~same)
    days = F.sequence(F.date_sub(F.col("n.first_event_ts").cast("date"), 1), F.date_add(F.col("n.last_event_ts").cast("date"), 1))
    return moved.select(F.explode(days).alias("day")).distinct()


def merge_dimension(known: DataFrame, staged: DataFrame, column: str, key: str, *extra: Column) -> DataFrame:
    """A dimension after a batch: each business key with its first and last event time and least source."""
    seen = staged.where(F.col(column).isNotNull()).groupBy(column).agg(F.min("event_ts").alias("first_seen"), F.max("event_ts").alias("last_seen"), F.min("source").alias("source"))
    rows = known.select(key, column, *[c for c in known.columns if c not in (key, column, "first_seen", "last_seen", "source")], "first_seen", "last_seen", *[c for c in known.columns if c == "source"])
    fresh = seen.select(surrogate(F.col(column)).alias(key), column, *extra, "first_seen", "last_seen", "source").select(*rows.columns)
    rest = [F.min(c).alias(c) for c in rows.columns if c not in (key, "first_seen", "last_seen")]
    return rows.unionByName(fresh).groupBy(key).agg(*rest, F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")).select(*known.columns)
