"""Registered queries with their SQL, by family."""
