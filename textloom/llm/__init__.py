"""Training-data operators: scoring, search, deduplication, mixing and packing."""
