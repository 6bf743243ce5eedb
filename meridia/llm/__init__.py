"""Training-data operators: quality, toxicity, duplicates, mixing, tokens, packing, search."""
