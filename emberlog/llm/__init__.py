"""Operators for preparing training corpora.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; ``queries`` holds the thin ``opN_<name>`` queries that the
driver entry registers.
"""
