"""Temporal segment analytics as composable PySpark transforms."""
