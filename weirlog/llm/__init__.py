"""Operators of a training-data pipeline: dedup, decontamination, quality, tokens, extraction."""
