"""Structured Streaming forms of the incremental collection."""
