"""Registered queries: each runs an operator over the given tables, with its SQL."""
