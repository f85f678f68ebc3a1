"""Column expressions: score shapes, versions, colours, rounding."""
