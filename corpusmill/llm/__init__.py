"""Operators of a training-data pipeline, one module each.

Nothing outside this subpackage imports it; ``queries.py`` holds the thin
contract queries and their SQL.
"""
