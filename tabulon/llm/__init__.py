"""Training-data operators: quality, dedup, fingerprints, sharding, formatting, mixing, scans, packing."""
