"""Operators for training data: search, language, deduplication, scoring, archives, mixing.

One module for an operator; `queries` registers them. Nothing else in the
library imports this subpackage.
"""
