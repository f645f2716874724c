"""Column functions: text, geometry, pixels."""
