"""Operators for preparing text corpora for language-model training.

Nothing outside this package imports it; the entry module adds its queries
only when the package is present.
"""
