"""Training-data operators: filtering, deduplication, search, scanning, mixing, sharding, tokenising.

Nothing outside this package imports it. ``queries`` and ``oracles`` hold what the entry module registers.
"""
