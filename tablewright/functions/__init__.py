"""Column expressions and shared building blocks of the operators."""
