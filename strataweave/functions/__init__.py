"""Column functions and their Python twins."""
