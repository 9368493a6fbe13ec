"""Training-data operators: quality, near-duplicates, repeats, packing, encoding, search.

Nothing outside this package imports it.
"""
