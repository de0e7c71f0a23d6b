"""Training-data operators: deduplication, decontamination, tokenizing, packing, search and classification."""
