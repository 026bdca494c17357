"""Operators that prepare chat messages and web pages as model training data."""
