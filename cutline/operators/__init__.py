"""Relational operators over named columns: windows, as-of, dedupe, lags, ranks."""
