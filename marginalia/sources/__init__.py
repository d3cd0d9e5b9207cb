"""Readers of source trees, datasets, run files and settings."""
