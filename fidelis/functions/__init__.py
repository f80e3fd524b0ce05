"""Column functions on report texts."""
