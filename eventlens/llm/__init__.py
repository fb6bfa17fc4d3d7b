"""Training-data operators: token counts, private data, search, classifiers, dedup, packing."""
