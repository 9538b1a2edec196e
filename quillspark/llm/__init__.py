"""Training-data operators: filtering, deduplication, tokenisation, scoring, sharding and formatting.

Nothing else in the library imports this subpackage; it can be removed as a whole.
"""
