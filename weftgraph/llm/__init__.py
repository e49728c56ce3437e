"""Training-data operators (token counts, sharding, PII, extraction, search, joins, packing, scans).

Nothing else in the library imports this subpackage; it can be removed as a whole.
"""
