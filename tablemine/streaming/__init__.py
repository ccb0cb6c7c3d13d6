"""Structured Streaming sources, scoring and sinks."""
