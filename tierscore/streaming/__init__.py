"""Structured Streaming forms of scoring and of the request-log analytics."""
