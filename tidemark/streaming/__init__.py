"""Structured Streaming over the change feed."""
