"""Operators of a training-data pipeline, and their queries over the driver tables."""
