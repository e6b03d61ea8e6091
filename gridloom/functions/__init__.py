"""Column expressions: data terms, buffer arithmetic, fuzzy norms, radial bases, colour and geometry."""
