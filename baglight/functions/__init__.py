"""Column expressions and small building blocks of the operators."""
