"""Column expressions: times, identifiers, addresses, paths."""
