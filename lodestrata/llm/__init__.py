"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it.  Every operator takes DataFrames,
selects the columns it needs (so extra or clashing columns are harmless) and
returns a DataFrame; added columns replace those of the same name.  ``queries.py`` holds the thin queries over the
standard tables.
"""
