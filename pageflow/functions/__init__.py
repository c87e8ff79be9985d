"""Column expressions: text, geometry, numbers, arrays."""
