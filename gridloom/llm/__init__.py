"""Operators of a training-data pipeline: deduplication, filtering, sharding, tokens and packing.

Nothing outside this subpackage imports it. ``queries`` holds the registered queries.
"""
