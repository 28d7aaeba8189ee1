"""Training-data operators: quality, media, search, packing, licences, PII, near and exact duplicates, tokens.

Nothing outside this folder imports it.
"""
