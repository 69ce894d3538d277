"""Queries over the given tables: each applies operators to tables that play their roles."""
