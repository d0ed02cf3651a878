"""Column functions: scoring, text rules and source literals."""
