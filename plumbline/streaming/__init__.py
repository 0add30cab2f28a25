"""Structured Streaming versions of the daily aggregates."""
