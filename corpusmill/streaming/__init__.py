"""Structured Streaming forms, beyond the batch operators."""
