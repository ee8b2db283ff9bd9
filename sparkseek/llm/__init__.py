"""Operators of a training-data pipeline over ``documents`` and ``embeddings``.

Self-contained: nothing else in the library imports this subpackage.
"""
