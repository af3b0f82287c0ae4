"""Column expressions: detection, rewriting, names."""
