"""Operators for preparing training data: archives, cleaning, mixing, encoding."""
