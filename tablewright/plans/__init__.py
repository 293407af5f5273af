"""Registered queries: an operator on the test tables, with the same result in SQL."""
