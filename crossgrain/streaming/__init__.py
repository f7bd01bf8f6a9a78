"""Structured Streaming ingest of daily rows."""
