"""Operators on whole tables: index maintenance, read queries, edits."""
