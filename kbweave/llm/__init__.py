"""Training-data operators (filtering, dedup, tokenising, sharding).

Nothing outside this package imports it; the entry module adds its queries only
when the package is present.
"""
