"""Operators for training-data pipelines: deduplication, quality, tokens, toxicity, licences, personal data, decontamination, language models."""
