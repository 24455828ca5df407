"""Incremental synchronisation and online metrics with Structured Streaming."""
