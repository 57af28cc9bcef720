"""Structured Streaming forms of the change feed and of the seen state."""
