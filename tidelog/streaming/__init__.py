"""Structured Streaming versions of ingest, counting and rule matching."""
