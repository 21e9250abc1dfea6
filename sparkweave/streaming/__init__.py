"""Structured Streaming: incremental ingest, request accounting."""
