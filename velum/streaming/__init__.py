"""Incremental refresh of the rating aggregates with Structured Streaming."""
