"""Queries over the given test tables, and the SQL each is checked against."""
