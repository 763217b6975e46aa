"""Operators for training-data pipelines: near-duplicates, neighbours, clusters, tokens, leaks, reading levels."""
