"""Training-data operators: dedup, decontamination, quality, PII, secrets, scoring and mixing."""
