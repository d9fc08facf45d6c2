"""Operators of a training-data pipeline: search, mixing, deduplication, extraction, packing."""
