"""The event contracts, as JSON Schema 2020-12 objects."""

from __future__ import annotations

# Field names, types, enumerations and bounds of the contracts, down to MAPPINGS.
EVENT_TYPES = ["gps_ping", "temperature", "status", "hub_scan"]
STATUSES = ["pickup", "in_transit", "exception", "delivered"]
REQUIRED = ["event_id", "event_type", "event_ts", "shipment_id", "source"]


def _pair(a: str, b: str, spec_a: dict, spec_b: dict) -> dict:
    """A nullable closed object with two required fields."""
    return {"type": ["object", "null"], "additionalProperties": False, "required": [a, b], "properties": {a: spec_a, b: spec_b}}


def _contract(**blocks: dict) -> dict:
    text = {"type": "string"}
    maybe = {"type": ["string", "null"]}
    properties = {
        "event_id": text | {"minLength": 8},
        "event_type": text | {"enum": EVENT_TYPES},
        "event_ts": text,
        "shipment_id": text | {"minLength": 4},
        "vehicle_id": maybe,
        "hub_code": maybe,
        "source": text,
        "status": maybe | {"enum": [*STATUSES, None]},
        "temperature_c": {"type": ["number", "null"], "minimum": -80, "maximum": 80},
        "metadata": {"type": ["object", "null"], "additionalProperties": True},
    }
    return {"type": "object", "additionalProperties": False, "required": REQUIRED, "properties": properties | blocks}


_LAT, _LON = {"type": "number", "minimum": -90, "maximum": 90}, {"type": "number", "minimum": -180, "maximum": 180}
_TEXT = {"type": "string"}
_GEO, _WINDOW = _pair("lat", "lon", _LAT, _LON), _pair("start", "end", _TEXT, _TEXT)

CONTRACTS: dict[str, dict] = {
    "v1": _contract(geo=_GEO, delivery_window=_WINDOW),
    "v2": _contract(geo=_GEO, delivery=_pair("window_start", "window_end", _TEXT, _TEXT)),
    "v3": _contract(position=_pair("latitude", "longitude", _LAT, _LON), delivery_window=_WINDOW),
}

#: How a version's paths become those of v1.
MAPPINGS: dict[str, dict[str, str]] = {
    "v1": {},
    "v2": {"delivery.window_start": "delivery_window.start", "delivery.window_end": "delivery_window.end"},
    "v3": {"position.latitude": "geo.lat", "position.longitude": "geo.lon"},
}
