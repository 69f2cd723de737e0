"""Operators that prepare text corpora for training: deduplication, filters, tokens, mixing, search.

Nothing else in the library imports this subpackage.
"""
