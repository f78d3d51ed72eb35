"""Training-data operators: quality, deduplication, decontamination, tokens, packing, sharding.

Nothing else in the library imports this subpackage.
"""
