"""Training-data operators: archives, binary shards, scans, models, mixing, search and near-duplicates.

Nothing outside this subpackage imports it, and it imports nothing from the rest of the library.
"""
