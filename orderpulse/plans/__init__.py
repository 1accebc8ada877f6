"""Fact construction and the named queries."""
