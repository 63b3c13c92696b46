"""Operators of a training-data pipeline over documents, pages and vectors.

Every module holds one operator. Nothing outside this package and ``corpus_pipeline`` imports it.
"""
