"""Operators that prepare training text: deduplication, scoring, packing, encoding, storage."""
