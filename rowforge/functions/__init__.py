"""Column expressions: canonical text, emptiness, JSON and CSV text."""
