"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  ``queries`` holds the
thin per-table queries, the other modules hold the operators.
"""
