"""Training-data operators: quality, sharding, tokenising, scoring, de-duplication, media, packing.

Nothing outside this subpackage imports it.
"""
