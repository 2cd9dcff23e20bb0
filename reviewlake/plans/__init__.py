"""Registered queries: an operator over the given tables, with its SQL twin."""
