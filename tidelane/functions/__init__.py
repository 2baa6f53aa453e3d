"""Column and ordering helpers."""
