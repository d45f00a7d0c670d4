"""Operators of a training-data pipeline: language, quality, near duplicates, search, mixing, packing, archives, scoring."""
