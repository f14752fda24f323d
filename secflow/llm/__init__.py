"""Training-data operators: quality, sharding, toxicity, tokens, archives, decontamination, de-duplication, privacy."""
