"""Column builders: sequences, text, identifiers."""
