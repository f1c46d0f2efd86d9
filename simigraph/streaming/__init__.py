"""Structured Streaming variants of the incremental scan."""
