"""Column expressions: guarded arithmetic, moments, ranks, bins, dates, random numbers."""
