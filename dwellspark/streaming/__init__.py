"""Streaming forms of the daily tables."""
