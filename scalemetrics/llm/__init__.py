"""Operators for training-data pipelines: cleaning, scoring, near-duplicates, mixing, packing, sharding."""
