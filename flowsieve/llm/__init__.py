"""Training-data operators: packing, dedup, quality, mixing, token files, URL filters."""
