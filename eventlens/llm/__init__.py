"""Operators for preparing training text: one module per operator, queries over the test tables in ``queries``."""
