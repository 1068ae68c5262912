"""Scalars and names."""
