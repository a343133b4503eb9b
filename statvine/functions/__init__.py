"""Column functions: citation forms, text, labels, vectors."""
