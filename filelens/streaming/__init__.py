"""Structured Streaming jobs that keep the index current."""
