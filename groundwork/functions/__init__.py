"""Column functions: fixed values and text."""
