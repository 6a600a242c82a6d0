"""Column functions: addresses, texts and vectors."""
