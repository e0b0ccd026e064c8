"""Column functions: text, numbers, geometry."""
