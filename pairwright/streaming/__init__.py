"""Structured Streaming wrappers for the row-local operators."""
