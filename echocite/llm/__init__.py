"""Operators of a training-data pipeline: de-duplication, scoring, tokens, packing, sharding."""
