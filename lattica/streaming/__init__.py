"""Incremental writers on Structured Streaming."""
