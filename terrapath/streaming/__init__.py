"""Structured Streaming forms of the query and progress operators."""
