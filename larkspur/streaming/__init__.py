"""Structured Streaming over files of events."""
