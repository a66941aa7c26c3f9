"""Training-data operators: sharding, deduplication, decontamination, mixing and the like.

Nothing else in the library imports this subpackage.
"""
