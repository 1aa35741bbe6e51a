"""Operators of a training-data pipeline: mixing, filtering, deduplication, scoring, packing."""
