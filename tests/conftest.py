import json
import sys
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from waybill.session import SETTINGS  # noqa: E402

NOW = datetime(2026, 3, 2, 9, 30, tzinfo=timezone.utc)


@pytest.fixture(scope="session")
def spark():
    builder = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def payload(n: int = 0, **changes) -> dict:
    """A v1 record; a change to None of a block keeps it as JSON null, to ... drops it."""
    at = NOW.isoformat()
    own = {"event_id": f"{n:032x}", "shipment_id": f"SHP-20260302-{n:08d}", "vehicle_id": "VEH-004711", "hub_code": "HUB-PT-017"}
    what = {"event_type": "status", "status": "in_transit", "source": "hub_scanner_net", "event_ts": at, "temperature_c": None}
    where = {"geo": {"lat": 38.7, "lon": -9.1}, "delivery_window": {"start": at, "end": (NOW + timedelta(hours=3)).isoformat()}, "metadata": {"conveyor": "CV-07"}}
    return {k: v for k, v in (own | what | where | changes).items() if v is not ...}


def records(spark, payloads):
    rows = [(json.dumps(p) if isinstance(p, dict) else p, i) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "raw_payload string, kinesis_seq long")
