"""Operators of a training-data pipeline.

Nothing else in the package imports this subpackage; ``registry`` lists its
queries and their SQL.
"""
