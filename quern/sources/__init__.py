"""Sources of Python files."""
