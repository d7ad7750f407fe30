"""Operators that prepare training data: repair, pairing, splitting, deduplication, encoding, packing."""
