"""Operators for preparing language-model training data.

Nothing else in the package imports this subpackage; the queries in
``queries.py`` are registered by the driver entry only if it is present.
"""
