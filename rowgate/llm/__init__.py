"""Operators for preparing text corpora for model training.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""
