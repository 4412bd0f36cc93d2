"""Structured Streaming: event fold and the incremental review."""
