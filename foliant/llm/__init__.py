"""Operators that prepare text for language-model training.

Nothing outside this package imports it; the package can be deleted without
breaking the rest.
"""
