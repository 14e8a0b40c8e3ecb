"""Structured Streaming stages, their sinks and their state tables."""
