"""Operators for preparing language-model training data.

Nothing outside this subpackage (and the pipeline built on it) imports it.
Each operator takes DataFrames and returns a DataFrame; the thin digests that
the registered queries return are derived from them in :mod:`.queries`.
"""
