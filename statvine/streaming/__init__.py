"""Structured Streaming ingest of new versions."""
