"""Corpus preparation for language-model training data, one module per operator.

Nothing outside this package imports it.
"""
