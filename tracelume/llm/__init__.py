"""Training-data operators: deduplication, decontamination, tokens, scoring, mixing."""
