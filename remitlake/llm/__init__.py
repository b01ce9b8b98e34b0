"""Operators for preparing training corpora: mixing, sharding, scoring, dedup, tokens, search.

Nothing outside this subpackage imports it.
"""
