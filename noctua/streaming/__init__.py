"""Structured Streaming forms of correlation and embedding backfill."""
