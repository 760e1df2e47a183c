"""Training-data operators: search, fingerprints, mixing, dedup, tokens, scans, filters.

Each module holds one operator.  Nothing outside this folder imports it.
"""
