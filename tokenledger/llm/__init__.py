"""Operators for preparing training text: dedup, filters, classifiers, mixing."""
