"""Column expressions: parsing, derived ids, value checks."""
