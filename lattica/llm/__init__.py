"""Operators that a large training-data pipeline needs.

Nothing outside this folder imports it. Every operator takes and returns
DataFrames; the registered queries are in ``queries``.
"""
