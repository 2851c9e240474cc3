"""Column functions: text, names and keys."""
