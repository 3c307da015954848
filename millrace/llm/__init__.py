"""Operators of a training-data pipeline: deduplication, filters, sharding, tokens.

Nothing else in the library imports this subpackage.
"""
