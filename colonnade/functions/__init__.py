"""Column to Column operators."""
