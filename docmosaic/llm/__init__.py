"""Training-data operators: extraction, decontamination, deduplication, scoring, filtering, media, mixing and joins."""
