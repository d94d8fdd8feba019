"""Operators of a training-data pipeline: dedup, search, token counts, archives, quality, PII and the like.

Nothing else in the library imports this subpackage.
"""
