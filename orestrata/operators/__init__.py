"""Relational operators on frames and tables."""
