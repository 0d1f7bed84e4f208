"""Operators for preparing language-model training data.

Nothing outside this folder imports it.  Each operator module has the general
operator; ``queries.py`` has the thin ``opN_`` queries and their oracle SQL.
"""
