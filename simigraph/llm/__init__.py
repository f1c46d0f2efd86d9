"""Operators for building training data from a corpus of documents.

Nothing outside this subpackage imports it; ``queries`` holds the registered
queries.
"""
