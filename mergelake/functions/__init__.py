"""Column functions: clocks, values and keys."""
