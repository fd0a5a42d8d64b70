"""Readers for relational, document, key-value and change-log sources."""
