"""Incremental ingest of review comments."""
