"""Column-level scalar functions."""
