"""Training-data operators: sharding, near-dedup, extraction, packing, filters.

Nothing outside this subpackage imports it; ``queries`` holds what the
registry at the repository top adds when the subpackage is present.
"""
