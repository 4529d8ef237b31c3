"""Structured Streaming ingest of quads."""
