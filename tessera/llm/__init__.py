"""Operators for large training-text pipelines.

Nothing else in the library imports this subpackage.  Each module holds one operator
with its own parameters and outputs; ``queries.py`` binds them to the given tables.
"""
