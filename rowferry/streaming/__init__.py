"""Structured Streaming front end of the change-data operators."""
