"""Operators of a training-data pipeline over documents and embeddings.

Nothing outside this folder imports it.  ``queries.py`` applies each operator to its whole table.
"""
