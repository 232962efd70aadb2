"""Operators for preparing language-model training text.

Nothing else in the package imports this subpackage. Every operator is a function
of DataFrames; the thin queries of the driver contract are in ``catalog``.
"""
