"""Incremental runs with durable, idempotent state."""
