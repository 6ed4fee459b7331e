"""Readers and derived input tables."""
