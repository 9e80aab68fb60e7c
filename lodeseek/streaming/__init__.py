"""Structured Streaming forms of the event rollup."""
