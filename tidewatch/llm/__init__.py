"""Operators for preparing training text: joins of near copies, dedup, packing, encoding, filters."""
