"""Operators for text and source-code training data. Nothing outside this package imports it."""
