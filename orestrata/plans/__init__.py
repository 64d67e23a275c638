"""Whole questions: analytic queries, gold tables, plan checks."""
