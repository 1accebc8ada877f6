"""Readers: tables, files, topics."""
