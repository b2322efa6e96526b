"""Operators for preparing language-model training corpora.

Nothing else in the library imports this subpackage, but for the scratch tables of ``common``; ``queries.py`` holds the
thin registered queries and their SQL.
"""
