"""Pipelines from raw files to typed tables, and what runs beside them."""
