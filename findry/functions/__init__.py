"""Column expressions: text, ids, seeded randomness, vectors and token arrays."""
