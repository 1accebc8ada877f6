"""Column → DataFrame operators."""
