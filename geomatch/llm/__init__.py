"""Operators of a training-data pipeline: extraction, language, toxicity, duplicates, scoring, packing, archives."""
