"""Operators of a training-data pipeline: deduplication, tokenising, scans and filters.

Nothing outside this subpackage imports it.
"""
