"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; the entry module adds its queries
when it can be imported.
"""
