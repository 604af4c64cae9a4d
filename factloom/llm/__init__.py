"""Training-data operators: classifiers, near-duplicate search, filters, packing, sharding, extraction, tokenisation.

Nothing outside this subpackage imports it.
"""
