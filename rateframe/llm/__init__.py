"""Operators for building training data: sharding, deduplication, search, scoring, cleaning, packing."""
