"""Operators for preparing large training corpora.

Nothing outside this subpackage imports it.  Every operator is a function (or
a small class) from DataFrames to DataFrames; the ``opN_*`` queries are thin
wrappers in :mod:`parley.llm.queries`.
"""
