"""Operators for training-data corpora: documents, labels, vectors and their derived tables.

Nothing outside this folder imports it.
"""
