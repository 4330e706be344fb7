"""Operators for preparing training text at scale.

Nothing outside this folder imports it.  Every operator takes and returns
DataFrames; ``queries.py`` holds the thin registered queries.
"""
