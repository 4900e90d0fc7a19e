"""Spark-first graph query and data processing engine."""
