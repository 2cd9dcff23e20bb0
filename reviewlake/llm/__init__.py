"""Operators for training-data preparation: one module per operator, queries in ``queries``."""
