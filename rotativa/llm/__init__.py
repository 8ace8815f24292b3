"""Operators for large text corpora used as training data; nothing outside this package imports it."""
