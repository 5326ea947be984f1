"""Operators of a training-data pipeline (sharding, mixing, near-duplicate
search, fingerprints, filters, formatting). Nothing outside imports it except
the entry module, which works without it."""
