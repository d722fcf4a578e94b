"""Operators for the preparation of training text. Nothing else in the package imports this folder."""
