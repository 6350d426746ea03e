"""Column functions: text, identifiers, vectors."""
