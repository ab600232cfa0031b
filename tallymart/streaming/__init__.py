"""Structured Streaming: message feed, request collapse, incremental refresh."""
