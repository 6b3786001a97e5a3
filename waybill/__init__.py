"""Waybill: shipment event analytics on Spark DataFrames."""
