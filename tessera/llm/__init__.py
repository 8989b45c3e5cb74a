"""Training-data operators: near-duplicate search, mixing, tokenising and filtering."""
