"""Column functions: scoring, text and vectors."""
