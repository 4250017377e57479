"""Training-data operators: cleaning, deduplication, scoring, mixing and packing of document tables.

Nothing outside this subpackage imports it.
"""
