"""Column functions and small axis tables."""
