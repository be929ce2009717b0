"""Training-data operators: dedup, scoring, filtering, mixing and packing of text corpora."""
