"""Training-data operators: language ID, tokenising, quality, deduplication, search."""
