"""Column expressions and multi-pass statistics the operators are made of."""
