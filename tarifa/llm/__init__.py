"""Operators for large training-text corpora, each one a DataFrame-to-DataFrame function.

Nothing outside this subpackage imports it.  ``queries`` holds the thin queries that apply
each operator to the tables of a data directory, and their SQL.
"""
