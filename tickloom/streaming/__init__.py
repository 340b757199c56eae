"""Structured Streaming over tick files."""
