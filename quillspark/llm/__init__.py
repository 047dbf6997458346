"""Training-data operators: deduplication, mixing, extraction, tokenising, classifying, media."""
