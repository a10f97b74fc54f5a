"""Operators for large text corpora: archives, filters, near-duplicates, models, mixing and sharding."""
