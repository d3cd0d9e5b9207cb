"""Corpus documentation analytics as PySpark DataFrame jobs."""
