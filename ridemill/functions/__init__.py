"""Column expressions: parsing, rounding, date arithmetic, tail probabilities."""
