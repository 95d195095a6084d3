"""Column expressions over names, paths and text."""
