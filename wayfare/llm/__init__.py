"""Operators for training data: text, URLs, archives, shards, duplicates, packing."""
