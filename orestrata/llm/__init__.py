"""Operators for preparing training data: search, privacy, scoring, filtering, deduplication, mixing, encoding."""
