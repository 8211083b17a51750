"""Training-data operators: fingerprints, packing, search, scoring, dedup, mixing, PII, language."""
