"""Column-expression helpers and shared aggregate building blocks."""
