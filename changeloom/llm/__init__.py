"""Operators for training-data pipelines: tokens, filters, extraction, near-duplicates, scoring and packing."""
