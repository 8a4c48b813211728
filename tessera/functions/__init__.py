"""Column functions: scores, decay, text preparation, vectors."""
