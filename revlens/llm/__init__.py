"""Operators of a training-data pipeline: search, shards, id files, filters, joins, packing."""
