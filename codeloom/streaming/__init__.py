"""Incremental upkeep of a graph with Structured Streaming."""
