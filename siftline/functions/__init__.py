"""Column expressions: identity, text and path functions."""
