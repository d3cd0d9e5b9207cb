"""Column functions: text, evidence and policy."""
