"""Queries over the given tables, with the same rows in SQL where it can express them."""
