"""Column functions and the small per-line helpers shared by the operators."""
