"""Operators of a training-data pipeline: tokenising, packing, filtering, deduplicating."""
