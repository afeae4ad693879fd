"""Operators for building language-model training data from a documents table.

Nothing outside this subpackage imports it.  Every operator takes a DataFrame
and column names, selects only the columns it needs (so further columns of any
name are harmless) and returns a new DataFrame keyed by the document id.
"""
