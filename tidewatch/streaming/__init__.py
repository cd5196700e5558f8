"""Structured Streaming topology, keyed state and sinks."""
