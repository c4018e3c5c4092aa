"""Training-data operators: tokens, packing, deduplication, quality, search and scoring."""
