"""Query catalogue: each operator over the test tables, with its SQL equivalent."""
