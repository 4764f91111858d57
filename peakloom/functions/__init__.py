"""Column functions: no operator here moves a row."""
