"""Training-data operators: secrets, page text, duplicates, packing, quality, leakage, language model, sharding."""
