"""Column functions and ordered-group helpers."""
