"""Column expressions and scalar statistics."""
