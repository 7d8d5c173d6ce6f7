"""Column expressions: text, labels, votes and schema helpers."""
