"""Operators for large training-text pipelines; nothing else in the library imports them."""
