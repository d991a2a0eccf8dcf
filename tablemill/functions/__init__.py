"""Column expressions and vector helpers."""
