"""Training-data operators: extraction, scans, deduplication, scoring, mixing and packing."""
