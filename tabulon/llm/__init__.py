"""Training-data operators: sharding, quality, packing, search, deduplication and more.

Nothing outside this subpackage imports it.
"""
