"""Training-data operators: formatting, extraction, quality, deduplication, tokens and packing."""
