"""Table adapters, readers and writers."""
