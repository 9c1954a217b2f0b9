"""Training-data operators: deduplication, filters, classifiers, tokenisation and search.

Nothing outside this subpackage imports it.
"""
