"""Operators of a training-data pipeline: cleaning, near duplicates, scoring,
packing, tokens and web archives. Nothing else in the package imports them."""
