"""Training-data operators (decontamination, token counts, toxicity, deduplication, PII,
quality, mixing). Nothing else in the library imports this subpackage."""
