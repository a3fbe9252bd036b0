"""Training-data operators (deduplication, quality, tokens, personal data, packing).

Nothing outside this subpackage imports it; the package works without it.
"""
