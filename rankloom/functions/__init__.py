"""Column and window functions."""
