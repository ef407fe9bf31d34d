"""Operators for large training-data pipelines, each built by the method named in its module."""
