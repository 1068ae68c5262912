"""Operators of plans: filters and relation filters, order and limits, nesting."""
