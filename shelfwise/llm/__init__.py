"""Operators of a training-data pipeline: cleaning, near-duplicates, scores, mixing, decontamination, token files."""
