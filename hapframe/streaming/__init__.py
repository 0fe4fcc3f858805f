"""Structured Streaming: sites stored and counted as they arrive."""
