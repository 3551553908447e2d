"""Whole retrieval plans made of operators."""
