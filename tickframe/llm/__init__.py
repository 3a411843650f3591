"""Training-data operators: extraction, formatting, scoring, media, filtering, packing, mixing, near-duplicates, sharding, language."""
