"""Structured Streaming over pages that arrive as files."""
