"""Training-data operators: filtering, deduplication, mixing, packing, sharding, search and binary output.

Nothing else in the library imports this subpackage; it can be removed on its own.
"""
