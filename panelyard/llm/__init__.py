"""Training-data operators: archives, filters, near-duplicates, fingerprints, packing."""
