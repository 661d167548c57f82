"""Queries over the given tables, one per operator, and the SQL that must agree with them."""
