"""Batch processing, streaming and replay."""
