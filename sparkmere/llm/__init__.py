"""Operators for preparing language-model training data at scale.

Nothing outside this subpackage imports it. ``queries.py`` registers one query for each operator.
"""
