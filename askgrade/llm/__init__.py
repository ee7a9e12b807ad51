"""Operators of a large-scale training-data pipeline, on tables of documents.

Nothing else in the library imports this subpackage.
"""
