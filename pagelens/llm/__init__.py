"""Operators that prepare training data: token output, duplicates, quality, mixing, packing, language."""
