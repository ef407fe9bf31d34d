"""Expressions and functions on single values."""
