"""Structured Streaming forms of the event-time operators."""
