"""Operators on DataFrames: chunking, search, fusion, evaluation, de-duplication."""
