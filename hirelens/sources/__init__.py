"""Readers and writers for captured pages, postings and snapshots."""
