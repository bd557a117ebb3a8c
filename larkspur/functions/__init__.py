"""Column functions: text, n-grams, vectors."""
