"""Training-data operators: text deduplication, tokenisation, filtering and packing.

Nothing else in the library imports this subpackage.
"""
