"""Structured Streaming over the batch operators (an extension)."""
