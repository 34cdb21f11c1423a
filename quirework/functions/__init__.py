"""Column-level functions and small helpers."""
