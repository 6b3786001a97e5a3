"""Thresholds and knobs, in one place."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    """Defaults of every tunable; ``from_env`` reads WAYBILL_<NAME>."""

    data_dir: str = "data"
    shards: int = 8
    shard_records_per_second: int = 1000
    max_read_records: int = 5000
    buffer_seconds: float = 2.0
    merge_interval_seconds: float = 4.0
    lateness_hours: int = 24
    late_minutes: int = 5
    violation_alert_pct: float = 0.5
    null_alert_pct: float = 15.0
    breaker_pct: float = 5.0
    freshness_alert_seconds: float = 30.0
    cooldown_seconds: float = 15.0
    canary_points: int = 12
    canary_least: int = 5
    canary_sigmas: float = 3.0
    redelivery_rate: float = 0.004
    late_rate: float = 0.01
    vehicles: int = 4000
    hubs: int = 240
    retention_days: int = 90
    compact_folders: int = 64
    seed: int = 7
    events_per_second: int = 900
    duration_seconds: int = 90

    @classmethod
    def from_env(cls, environ=os.environ) -> "Config":
        found = {}
        for f in fields(cls):
            if (value := environ.get(f"WAYBILL_{f.name.upper()}")) is not None:
                found[f.name] = type(f.default)(value)
        return cls(**found)
