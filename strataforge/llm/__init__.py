"""Training-corpus operators: WARC, BPE, packing, quality, sharding and the dedup family.

Nothing else in the library imports this subpackage.
"""
