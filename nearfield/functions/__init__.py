"""Column expressions and values."""
