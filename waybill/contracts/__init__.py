"""Versioned event contracts and their compiler."""

from waybill.contracts.registry import Registry
from waybill.contracts.versions import CONTRACTS, MAPPINGS

__all__ = ["CONTRACTS", "MAPPINGS", "Registry"]
