"""Operators for preparing large text corpora.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its general interface; ``queries`` holds the thin registered
queries and ``oracles`` the SQL they are compared with.
"""
