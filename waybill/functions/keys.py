"""Hash keys and other scalar helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "||"


def surrogate(key: Column) -> Column:
    """md5 of a business key; null stays null."""
    return F.md5(key)


def hash_key(*parts: Column) -> Column:
    """SHA-1 of the trimmed, upper-cased parts, for feeds that write keys in different ways."""
    return F.sha1(F.concat_ws(SEPARATOR, *[F.upper(F.trim(p)) for p in parts]))


def hash_diff(*parts: Column) -> Column:
    """md5 over the parts, null as empty."""
    return F.md5(F.concat_ws(SEPARATOR, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def fixed(number: Column) -> Column:
    """A coordinate or temperature as text that doesn't depend on the engine's float format."""
    return number.cast("decimal(10,5)").cast("string")


def minutes_between(a: Column, b: Column) -> Column:
    """Minute boundaries from a to b."""
    return _boundaries("minute", a, b, 60)


def seconds_between(a: Column, b: Column) -> Column:
    """Second boundaries from a to b."""
    return _boundaries("second", a, b, 1)


def _boundaries(unit: str, a: Column, b: Column, seconds: int) -> Column:
    at = lambda x: F.unix_timestamp(F.date_trunc(unit, x).cast("timestamp"))
    return ((at(b) - at(a)) / seconds).cast("long")


def partition_key(vehicle: Column, hub: Column, shipment: Column) -> Column:
    """The first of the three that isn't empty."""
    return F.coalesce(F.nullif(vehicle, F.lit("")), F.nullif(hub, F.lit("")), shipment)


def shard_id(key: Column, shards: int) -> Column:
    return F.format_string("shardId-%012d", F.pmod(F.crc32(key), F.lit(shards)))


def payload_time(text: Column) -> Column:
    """An ISO time as UTC instant; naive is UTC, unparsable is null."""
    return F.try_to_timestamp(text)
