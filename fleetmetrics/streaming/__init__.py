"""Structured Streaming forms of ingest, collection, status, expiry and change feeds."""
