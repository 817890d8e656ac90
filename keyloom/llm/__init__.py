"""Operators of training-data pipelines: search, scans, deduplication, scoring, mixing, packing.

Nothing else in the library imports this subpackage. Every operator takes and returns
DataFrames; the thin registered queries and their SQL are in ``queries``.
"""
