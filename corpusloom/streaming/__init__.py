"""Incremental indexing on Structured Streaming."""
