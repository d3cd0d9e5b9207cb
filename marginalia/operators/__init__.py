"""Relational operators over items, changes, findings and evaluation runs."""
