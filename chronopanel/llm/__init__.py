"""Operators of a training-data pipeline: text filtering, deduplication, mixing, packing and search."""
