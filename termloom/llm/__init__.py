"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Queries are in ``catalog``.
"""
