"""Operators for large text collections: cleaning, language, duplicates, leakage, mixing and screening."""
