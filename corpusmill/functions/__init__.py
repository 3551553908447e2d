"""Column functions on text, keys and numbers."""
