"""Operators for preparing large text corpora.

Nothing outside this subpackage imports it.  ``queries`` holds the registered
queries and ``oracle`` the SQL that some of them can be compared with.
"""
