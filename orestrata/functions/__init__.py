"""Scalar building blocks: functions from columns to a column, all of Spark's own expressions."""
