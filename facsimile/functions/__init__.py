"""Column expressions: missing values, keyed randomness, estimators."""
