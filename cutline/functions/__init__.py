"""Column expressions: shares, clamps, shrinkage, credits and mappings."""
