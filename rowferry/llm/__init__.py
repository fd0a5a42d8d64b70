"""Operators for training-data pipelines: deduplication, filters, scoring, tokens."""
