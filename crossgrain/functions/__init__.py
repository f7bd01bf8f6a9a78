"""Column expressions and window helpers that the operators are made of."""
