"""Operators for large training corpora.

Nothing else in the library imports this subpackage; it may be deleted as a
whole.  Every module states the result for nulls, empty and very long texts,
ties, repeated rows, empty tables and clashing extra columns.
"""
