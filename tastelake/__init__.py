"""Recommendation analytics as PySpark DataFrame jobs."""
